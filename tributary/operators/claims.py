"""Claims of BASE, their survival in each cut, and the interaction of two cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import config
from tributary.operators.merge import SIDES
from tributary.operators.ordered import scanned
from tributary.sources.derived import draw


def derived_claims(base: DataFrame) -> DataFrame:
    """(merge_id, claim_id, base_index, claim_type, importance): every third shot, by hash, states a claim."""
    h = draw(F.col("merge_id"), F.col("base_index"), F.lit("claim"))
    rows = base.withColumn("h", h).where("h % 3 = 0")
    kinds = F.array(*map(F.lit, ["fact", "instruction", "condition", "warning"]))
    ranks = F.array(*map(F.lit, config.IMPORTANCE))
    return rows.select(
        "merge_id", F.format_string("claim_%04d", F.col("base_index")).alias("claim_id"), "base_index",
        F.element_at(kinds, (F.floor(F.col("h") / 3) % 4 + 1).cast("int")).alias("claim_type"),
        F.element_at(ranks, (F.floor(F.col("h") / 16) % 4 + 1).cast("int")).alias("importance"),
        (F.floor(F.col("h") / 64) % 2 == 0).alias("repeated"),
    )


def claim_regions(claims: DataFrame, base: DataFrame) -> DataFrame:
    """Evidence is the claim's shot; a repeated claim has the next shot as an equivalent."""
    shots = base.select("merge_id", F.col("base_index").alias("at"), "start", "end")
    places = F.when(F.col("repeated"), F.array(F.struct(F.lit("evidence").alias("kind"), F.lit(0).alias("o")), F.struct(F.lit("equivalent").alias("kind"), F.lit(1).alias("o")))).otherwise(F.array(F.struct(F.lit("evidence").alias("kind"), F.lit(0).alias("o"))))
    rows = claims.select("merge_id", "claim_id", "base_index", F.explode(places).alias("p"))
    rows = rows.select("merge_id", "claim_id", F.col("p.kind").alias("kind"), (F.col("base_index") + F.col("p.o")).alias("at"))
    return rows.join(shots, ["merge_id", "at"]).select("merge_id", "claim_id", "kind", "start", "end")


def cuts(units: DataFrame, base: DataFrame) -> DataFrame:
    """BASE ranges that a branch deletes or replaces."""
    gone = units.where(F.col("kind").isin("delete", "replace")).select("merge_id", "branch", "base_index")
    return gone.join(base.select("merge_id", "base_index", "start", "end"), ["merge_id", "base_index"]).select("merge_id", "branch", F.col("start").alias("cut_start"), F.col("end").alias("cut_end"))


def project(regions: DataFrame, cut_ranges: DataFrame, branches: tuple[str, ...] = SIDES) -> DataFrame:
    """Regions that survive each branch: those overlapping no cut (half open).

    A cut hits a region if it starts before the region's end and ends after its
    start, so the farthest end of the cuts that start before decides.  Cuts and
    regions stand in one timeline with that end so far: one sort, however many
    cuts a merge has.  Without a time nothing is hit.
    """
    names = F.explode(F.array(*map(F.lit, branches)))
    asked = regions.withColumn("branch", names).withColumn("_at", F.col("end")).withColumn("_turn", F.lit(0))
    gone = cut_ranges.select("merge_id", "branch", F.col("cut_start").alias("_at"), F.col("cut_end").alias("_end"), F.lit(1).alias("_turn"))
    # At equal times the region comes first: a cut that starts where it ends misses it.
    rows = scanned(asked.unionByName(gone.where("_at is not null"), allowMissingColumns=True), ["merge_id", "branch"], ["_at", "_turn"], tops={"_reach": F.col("_end")})
    alive = F.col("start").isNull() | F.col("end").isNull() | ~F.coalesce(F.col("_reach") > F.col("start"), F.lit(False))
    return rows.where((F.col("_turn") == 0) & alive).select(*regions.columns, "branch")


def intersect(projected: DataFrame) -> DataFrame:
    """Regions that survive both branches, by their full value; A's repeats stay."""
    value = ["merge_id", "claim_id", "kind", "start", "end"]
    a = projected.where("branch = 'branch_a'").drop("branch")
    b = projected.where("branch = 'branch_b'").select(*value)
    return a.join(b, value, "left_semi")


def surrogate(claims: DataFrame, projected: DataFrame) -> DataFrame:
    """(merge_id, claim_id, view, status): preserved while any region survives, else broken."""
    alive = projected.select("merge_id", "claim_id", F.col("branch").alias("view")).unionByName(intersect(projected).select("merge_id", "claim_id", F.lit("combined").alias("view")))
    counts = alive.groupBy("merge_id", "claim_id", "view").agg(F.count("*").alias("n"))
    every = claims.select("merge_id", "claim_id", F.explode(F.array(*map(F.lit, [*SIDES, "combined"]))).alias("view"))
    return every.join(counts, ["merge_id", "claim_id", "view"], "left").select("merge_id", "claim_id", "view", F.coalesce("n", F.lit(0)).alias("n_regions"), F.when(F.coalesce("n", F.lit(0)) > 0, "preserved").otherwise("broken").alias("status"))


def with_verdicts(statuses: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """A provider's verdicts where it has any, else the surrogate's, with the confidence and rationale of either.

    ``verdicts`` (merge_id, claim_id, view, status, confidence and, if it has
    one, rationale) may be absent: then every status is the surrogate's.
    """
    keys = ["merge_id", "claim_id", "view"]
    if verdicts is None:
        verdicts = statuses.where("false").withColumn("confidence", F.lit(1.0))
    reason = F.col("rationale") if "rationale" in verdicts.columns else F.lit(None).cast("string")
    v = verdicts.select(*keys, F.col("status").alias("v_status"), F.col("confidence").alias("v_confidence"), reason.alias("v_rationale"))
    rows = statuses.join(v, keys, "left")
    none = F.when(F.col("v_status").isNull(), config.SURROGATE_RATIONALE).otherwise(F.lit("no rationale given"))
    return rows.select(
        *keys, F.coalesce("v_status", "status").alias("status"), F.coalesce("v_confidence", F.lit(1.0)).alias("confidence"), F.col("v_status").isNull().alias("surrogate"), F.coalesce("v_rationale", none).alias("rationale")
    )


def from_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, regions) of extracted claim records with nested evidence_regions and equivalents.

    ``records`` has merge_id, claim_id, meaning, claim_type, importance and the
    two arrays of (start, end, description).
    """
    claims = records.select("merge_id", "claim_id", "meaning", "claim_type", "importance")
    labelled = [F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<start:double,end:double,description:string>>")), lambda r, k=kind: F.struct(F.lit(k).alias("kind"), r["start"].alias("start"), r["end"].alias("end"), r["description"].alias("description"))) for c, kind in (("evidence_regions", "evidence"), ("equivalents", "equivalent"))]
    regions = records.select("merge_id", "claim_id", F.explode(F.concat(*labelled)).alias("r")).select("merge_id", "claim_id", "r.*")
    return claims, regions


def derived_verdicts(claims: DataFrame) -> DataFrame:
    """A stand-in verdict table: a hash gives a status and confidence to four fifths of the (claim, view) pairs."""
    rows = claims.select("merge_id", "claim_id", F.explode(F.array(*map(F.lit, [*SIDES, "combined"]))).alias("view"))
    rows = rows.withColumn("h", draw(F.col("merge_id"), F.col("claim_id"), F.col("view"))).where("h % 5 <> 0")
    status = F.when(F.floor(F.col("h") / 5) % 4 == 0, "broken").when(F.floor(F.col("h") / 5) % 4 == 1, "degraded").otherwise("preserved")
    return rows.select("merge_id", "claim_id", "view", status.alias("status"), (F.floor(F.col("h") / 20) % 101 / 100.0).alias("confidence"))


def rule(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """(interaction, rule) from the statuses in A, B and the combination."""
    new = (c == "broken") & (a != "broken") & (b != "broken")
    return F.when(new, "creates_new_conflict").otherwise("none"), F.when(new, "R1").when(c == "broken", "R2").when(c == "degraded", "R3").otherwise("R4")


def interactions(statuses: DataFrame, claims: DataFrame) -> DataFrame:
    """One row for each claim judged in all three views."""
    one = lambda v: F.max(F.when(F.col("view") == v, F.col("status")))
    wide = statuses.groupBy("merge_id", "claim_id").agg(one("branch_a").alias("a_status"), one("branch_b").alias("b_status"), one("combined").alias("c_status")).dropna()
    what, which = rule(F.col("a_status"), F.col("b_status"), F.col("c_status"))
    rows = wide.withColumn("interaction", what).withColumn("rule_id", which).join(claims.select("merge_id", "claim_id", "claim_type", "importance"), ["merge_id", "claim_id"])
    prose = F.format_string("%s: A %s, B %s, together %s", F.col("claim_id"), F.col("a_status"), F.col("b_status"), F.col("c_status"))
    return rows.withColumn("explanation", F.when(F.col("interaction") != "none", prose))


def _rank(column: str, order: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in order.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def overall(merges: DataFrame, inter: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row for each merge: worst interaction, combined impact, mean confidence, call counts, conflict flag."""
    worst = inter.groupBy("merge_id").agg(
        F.max_by("interaction", F.struct(_rank("interaction", config.INTERACTION_SEVERITY), _rank("importance", config.IMPORTANCE))).alias("w"),
        F.count_if(F.col("interaction") != "none").alias("explanation_calls"),
    )
    rank = _rank("status", config.STATUS_SEVERITY)
    seen = statuses.groupBy("merge_id").agg(F.max(F.when(F.col("view") == "combined", rank)).alias("severity"), F.avg("confidence").alias("mean_confidence"), F.count("*").alias("evaluation_calls"))
    rows = merges.select("merge_id").distinct().join(worst, "merge_id", "left").join(seen, "merge_id", "left")
    names = F.array(*map(F.lit, config.STATUS_SEVERITY))
    overall_interaction = F.coalesce("w", F.lit("none"))
    summary = F.when(overall_interaction == "creates_new_conflict", "The edits conflict when combined.").otherwise("The edits combine safely.")
    return rows.select(
        "merge_id", overall_interaction.alias("overall_interaction"), F.element_at(names, F.coalesce("severity", F.lit(0)) + 1).alias("overall_impact"),
        F.coalesce("mean_confidence", F.lit(0.0)).alias("overall_confidence"), F.coalesce("evaluation_calls", F.lit(0)).alias("evaluation_calls"),
        F.coalesce("explanation_calls", F.lit(0)).alias("explanation_calls"), (overall_interaction == "creates_new_conflict").alias("conflict"), summary.alias("summary"),
    )
