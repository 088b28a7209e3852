"""Records that a client of the analysis reads: timeline, claims with evidence, response and forensic JSON.

One record belongs to one merge, so what is gathered into it is bounded by that
merge's shots and claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import config
from tributary.operators import claims as C
from tributary.operators.merge import SIDES

MERGE = "merge_id"
CLAIM = ["merge_id", "claim_id"]


def _shot(index: str) -> Column:
    return F.format_string("shot_%04d", index)


def timeline(slices: DataFrame, attached: DataFrame) -> DataFrame:
    """(merge_id, base_index, start, end, verdict, text, reason): the combination, and why each position came out so."""
    listed = F.array_sort(F.collect_list(F.struct("branch", "branch_index")))
    names = F.transform(listed, lambda i: F.concat(i["branch"], F.lit("@"), i["branch_index"].cast("string")))
    inserts = attached.groupBy(MERGE, F.col("anchor").alias("base_index")).agg(F.array_join(names, ", ").alias("inserts"))
    rows = slices.join(inserts, [MERGE, "base_index"], "left")
    a, b = F.coalesce("a_kind", F.lit("unchanged")), F.coalesce("b_kind", F.lit("unchanged"))
    id_, same = F.concat(F.lit("("), _shot("base_index"), F.lit(")")), F.col("verdict") != "unresolved"
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    reason = F.when(F.col("inserts").isNotNull(), said("unanchored insert(s) at BASE position ", _shot("base_index"), ": ", F.col("inserts")))
    for kind, done, b_wins in (("replace", "replaced", "B's replacement"), ("trim", "trimmed", "B's trim")):
        both = said(f"both branches {done} this BASE position ", id_)
        reason = reason.when((a == kind) & (b == kind), F.when(same, said(both, " with identical text")).otherwise(said(both, " with DIFFERENT text; no deterministic winner")))
        a_wins = "A's replacement" if kind == "replace" else "trim"
        reason = reason.when((a == kind) & (b == "unchanged"), said(f"branch_a {done}; branch_b left unchanged ", id_, f"; {a_wins} wins"))
        reason = reason.when((a == "unchanged") & (b == kind), said(f"branch_a left unchanged; branch_b {done} ", id_, f"; {b_wins} wins"))
    reason = (
        reason.when((a == "delete") & (b == "delete"), said("both branches deleted this BASE position ", id_))
        .when((a == "delete") & (b == "unchanged"), said("branch_a deleted; branch_b left unchanged ", id_, "; delete wins"))
        .when((a == "unchanged") & (b == "delete"), said("branch_a left unchanged; branch_b deleted ", id_, "; delete wins"))
        .when((a == "unchanged") & (b == "unchanged"), said("both branches left this BASE position unchanged ", id_))
        .otherwise(said("incompatible same-base dual edits ", id_, ": branch_a=", a, ", branch_b=", b, "; no deterministic winner"))
    )
    return rows.select(MERGE, "base_index", "start", "end", "verdict", F.col("combined_text").alias("text"), reason.alias("reason"))


def _regions(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Regions of each key in one list: evidence before equivalents, each by time."""
    described = F.col("description") if "description" in rows.columns else F.col("kind")
    part = F.struct((F.col("kind") == "equivalent").alias("o"), "start", "end", described.alias("description"))
    plain = F.transform(F.array_sort(F.collect_list(part)), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["description"].alias("description")))
    return rows.groupBy(*keys).agg(plain.alias(name))


def claim_responses(inter: DataFrame, meanings: DataFrame, regions: DataFrame, projected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row for each interaction whose claim has a verdict in all three views.

    base_evidence is the claim's evidence with its equivalents; a view's
    evidence is what survives there, empty where the status is broken or comes
    from the surrogate.  ``meanings`` has merge_id, claim_id, claim.
    """
    empty = F.array().cast("array<struct<start:double,end:double,description:string>>")
    alive = projected.withColumnRenamed("branch", "view")
    alive = alive.unionByName(C.intersect(projected).withColumn("view", F.lit("combined")))
    seen = verdicts.join(_regions(alive, [*CLAIM, "view"], "survives"), [*CLAIM, "view"], "left")
    evidence = F.when(F.col("surrogate") | (F.col("status") == "broken"), empty).otherwise(F.coalesce("survives", empty))
    effect = F.struct("status", "rationale", evidence.alias("evidence"))
    wide = seen.withColumn("effect", effect).groupBy(*CLAIM).agg(*[F.first(F.when(F.col("view") == v, F.col("effect")), ignorenulls=True).alias(v) for v in (*SIDES, "combined")])
    rows = inter.join(wide.dropna(), CLAIM).join(_regions(regions, CLAIM, "base_evidence"), CLAIM, "left").join(meanings, CLAIM, "left")
    return rows.select(
        *CLAIM, "claim", "claim_type", "importance", F.coalesce("base_evidence", empty).alias("base_evidence"), *SIDES, "combined", "interaction", F.col("rule_id").alias("deterministic_rule"), "explanation"
    )


def responses(totals: DataFrame, claim_rows: DataFrame, slices: DataFrame) -> DataFrame:
    """(merge_id, response): the public JSON answer of each merge."""
    listed = lambda rows, columns, name: rows.groupBy(MERGE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    claims_of = listed(claim_rows, [c for c in claim_rows.columns if c != MERGE], "claims")
    slices_of = listed(slices, [c for c in slices.columns if c != MERGE], "combined_timeline")
    told = F.coalesce(*[F.when(F.col("overall_interaction") == k, v) for k, v in config.SUMMARIES.items()])
    rows = totals.join(claims_of, MERGE, "left").join(slices_of, MERGE, "left")
    body = F.struct(
        (F.col("overall_interaction") != "none").alias("conflict_detected"), F.col("overall_interaction").alias("interaction"), "overall_impact", "overall_confidence", told.alias("summary"), "claims", "combined_timeline"
    )
    return rows.select(MERGE, F.to_json(body).alias("response"))


def forensics(totals: DataFrame, claim_rows: DataFrame, views: DataFrame, edits: DataFrame, focused: bool = False) -> DataFrame:
    """(merge_id, artifact): all that led to a merge's verdict as one JSON record.

    Holds the claims with evidence and statuses, the rollups, call counts, and
    what each view says beside the edits that made it; ``focused`` leaves out
    the views' lines and keeps counts of the evidence.
    """
    kept = [c for c in claim_rows.columns if c != MERGE]
    if focused:
        kept = [c for c in kept if c not in (*SIDES, "combined")] + [F.size("base_evidence").alias("n_evidence_regions")] + [F.col(v)["status"].alias(f"{v}_status") for v in (*SIDES, "combined")]
    claims_of = claim_rows.groupBy(MERGE).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("claims"))
    said = views.where(F.trim("text") != "").groupBy(MERGE, "view").agg(F.array_sort(F.collect_list(F.struct("base_index", "operation", "text"))).alias("lines"))
    made = edits.groupBy(MERGE, F.col("branch").alias("view")).agg(F.array_sort(F.collect_list(F.struct("base_index", "operation", "confidence"))).alias("edit_metadata"))
    shown = said.join(made, [MERGE, "view"], "full").groupBy(MERGE).agg(F.array_sort(F.collect_list(F.struct("view", "lines", "edit_metadata"))).alias("representation"))
    counts = F.struct(F.col("evaluation_calls").alias("evaluation"), F.col("explanation_calls").alias("explanation"))
    rows = totals.join(claims_of, MERGE, "left")
    parts = ["claims", "overall_interaction", "overall_impact", "overall_confidence", counts.alias("call_counts")]
    if not focused:
        rows, parts = rows.join(shown, MERGE, "left"), [*parts, "representation"]
    return rows.select(MERGE, F.to_json(F.struct(*parts)).alias("artifact"))
