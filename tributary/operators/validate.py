"""Closed-schema validation of model output and edit-script application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary import config
from tributary.functions import text as T

STATUSES = list(config.STATUS_SEVERITY)


def closed_json(raw: Column, schema: str, fields: list[str]) -> tuple[Column, Column]:
    """(parsed, problem): the record and why it is refused: malformed, unknown key or missing key."""
    body = T.unfenced_json(raw)
    keys = F.json_object_keys(body)
    parsed = F.from_json(body, schema)
    known = F.array(*map(F.lit, fields))
    problem = (
        F.when(keys.isNull(), "malformed").when(F.size(F.array_except(keys, known)) > 0, "unknown key").when(F.size(F.array_except(known, keys)) > 0, "missing key")
    )
    return parsed, problem


def _object(value: Column) -> Column:
    """The fields of a variant that holds an object, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the lambda's variable is bound to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fields(m: Column, required: list[str], optional: list[str]) -> Column:
    """Why an object's keys are refused, null if they aren't."""
    keys, known, needed = F.map_keys(m), F.array(*map(F.lit, [*required, *optional])), F.array(*map(F.lit, required))
    return F.when(m.isNull(), "malformed").when(F.size(F.array_except(keys, known)) > 0, "unknown key").when(F.size(F.array_except(needed, keys)) > 0, "missing key")


def _refuse(**checks: Column) -> Column:
    """The first check that doesn't hold, by name; what can't be judged (a null) doesn't hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name.replace("_", " ")) for name, ok in checks.items()])


def _text(value: Column) -> Column:
    """The string that a variant holds, null for any other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    """The number that a variant holds, in quotes or not; null for lists, objects and other texts."""
    return F.try_variant_get(value, "$", "double")


def _filled(value: Column) -> Column:
    return F.length(_text(value)) >= 1


def _member(value: Column, names: list[str]) -> Column:
    return _text(value).isin(*names)


def _empty_or(value: Column, ok: Column) -> Column:
    """For fields that may be null: absent, null, or what ``ok`` says."""
    return value.isNull() | (F.schema_of_variant(value) == "VOID") | ok


def _every(value: Column, ok) -> Column:
    """Whether a variant is absent, or a list of which every element is sound; null is no list."""
    return value.isNull() | F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(ok(x), F.lit(False))), F.lit(False))


def _texts(value: Column) -> Column:
    return _every(value, lambda x: _text(x).isNotNull())


def _spans(value: Column, videos: list[str] | None = None) -> Column:
    """Whether a list holds only sound spans: the known fields, times of 0 or more, no end before its start, a description."""
    names = ["start", "end", "description", *(["video"] if videos else [])]

    def sound(m: Column) -> Column:
        ok = _fields(m, names, []).isNull() & (_number(m["start"]) >= 0) & (_number(m["end"]) >= _number(m["start"])) & _filled(m["description"])
        return ok & _member(m["video"], videos) if videos else ok

    return _every(value, lambda x: _with(_object(x), sound))


def _judged(raw: Column, problem) -> Column:
    """``problem`` of the fields of a JSON object, parsed once.

    What is no JSON, repeats a key or has text after its object has no fields:
    the parser stops at a value's end, so the value is parsed as a list's only one.
    """
    only = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    return _with(F.when(F.size(only) == 1, _object(F.try_element_at(only, F.lit(1)))), problem)


def claim_problem(raw: Column) -> Column:
    """Why an extracted claim record is refused (null: sound)."""
    return _judged(
        raw,
        lambda m: F.coalesce(
            _fields(m, ["claim_id", "meaning", "claim_type", "importance"], ["evidence_regions", "equivalents"]),
            _refuse(
                blank_claim_id=_filled(m["claim_id"]), blank_meaning=_filled(m["meaning"]), claim_type=_member(m["claim_type"], config.CLAIM_TYPES),
                importance=_member(m["importance"], list(config.IMPORTANCE)), evidence=_spans(m["evidence_regions"]), equivalents=_spans(m["equivalents"]),
            ),
        ),
    )


def survival_problem(raw: Column) -> Column:
    """Why a verdict on one claim in one view is refused (null: sound)."""
    return _judged(
        raw,
        lambda m: F.coalesce(
            _fields(m, ["claim_id", "branch", "status", "rationale"], ["surviving_evidence"]),
            _refuse(
                claim_id=_text(m["claim_id"]).isNotNull(), branch=_member(m["branch"], ["branch_a", "branch_b", "combined"]), status=_member(m["status"], STATUSES),
                evidence=_spans(m["surviving_evidence"]), blank_rationale=_filled(m["rationale"]),
            ),
        ),
    )


VIDEOS = ["base", "branch_a", "branch_b", "merged"]


def _share(value: Column) -> Column:
    return _number(value).between(0, 1)


def _impact_problem(m: Column) -> Column:
    return F.coalesce(
        _fields(m, ["branch", "impact_level", "confidence", "rationale"], ["affected_claims", "preserved_equivalents", "evidence"]),
        _refuse(
            branch=_member(m["branch"], ["branch_a", "branch_b"]), impact_level=_member(m["impact_level"], STATUSES), evidence=_spans(m["evidence"], VIDEOS), confidence=_share(m["confidence"]),
            blank_rationale=_filled(m["rationale"]), affected_claims=_texts(m["affected_claims"]), preserved_equivalents=_texts(m["preserved_equivalents"]),
        ),
    )


INTERACTION_TEXTS = ["base_claim", "branch_a_effect", "branch_b_effect", "combined_effect", "recommended_resolution"]


def _interaction_sound(m: Column) -> Column:
    keys = _fields(m, ["combined_impact", "interaction_type", "confidence", *INTERACTION_TEXTS], ["branch_a_edit_ids", "branch_b_edit_ids", "conflict_type", "evidence"])
    ok = keys.isNull() & _member(m["combined_impact"], STATUSES) & _member(m["interaction_type"], list(config.INTERACTION_SEVERITY)) & _empty_or(m["conflict_type"], _member(m["conflict_type"], config.CONFLICT_TYPES))
    ok = ok & _spans(m["evidence"], VIDEOS) & _share(m["confidence"]) & _texts(m["branch_a_edit_ids"]) & _texts(m["branch_b_edit_ids"])
    for name in INTERACTION_TEXTS:
        ok = ok & _filled(m[name])
    return ok


LEGACY_FLAGS = ["branch_a_safe", "branch_b_safe", "combined_safe"]


def _flags(m: Column) -> Column:
    ok = _fields(m, LEGACY_FLAGS, []).isNull()
    for name in LEGACY_FLAGS:
        ok = ok & (F.schema_of_variant(m[name]) == "BOOLEAN")
    return ok


def analysis_problem(raw: Column) -> Column:
    """Why a two-axis analysis is refused (null: sound): its fields, both branches' impacts, and every one of its interactions, of which a given list needs one."""

    def branch(m: Column, name: str) -> Column:
        return _with(_object(m[f"{name}_impact"]), lambda i: F.concat(F.lit(f"{name}: "), _impact_problem(i)))

    def problem(m: Column) -> Column:
        pairs = m["interactions"]
        return F.coalesce(
            _fields(m, ["branch_a_impact", "branch_b_impact", "combined_impact", "overall_confidence"], ["interactions", "notes", "legacy_v1_compat"]),
            branch(m, "branch_a"),
            branch(m, "branch_b"),
            _refuse(
                combined_impact=_member(m["combined_impact"], STATUSES), overall_confidence=_share(m["overall_confidence"]),
                no_interaction=pairs.isNull() | (F.size(F.try_variant_get(pairs, "$", "array<variant>")) > 0), interaction=_every(pairs, lambda x: _with(_object(x), _interaction_sound)),
                notes=_empty_or(m["notes"], _text(m["notes"]).isNotNull()), legacy_v1_compat=_empty_or(m["legacy_v1_compat"], _with(_object(m["legacy_v1_compat"]), _flags)),
            ),
        )

    return _judged(raw, problem)


def expected_payload(a: Column, b: Column, combined: Column, interaction: Column) -> Column:
    """The analysis JSON that a perfect provider would return for an expected label, for dry runs."""
    seen = F.array(F.struct(F.lit("base").alias("video"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("synthetic").alias("description")))
    none = F.array().cast("array<string>")
    shot = F.array(F.lit("shot_0000"))

    def impact(name: str, level: Column) -> Column:
        return F.struct(
            F.lit(name).alias("branch"), level.alias("impact_level"), F.array(F.lit("synthetic claim")).alias("affected_claims"), none.alias("preserved_equivalents"), seen.alias("evidence"),
            F.lit(1.0).alias("confidence"), F.concat(F.lit("synthetic dry-run, expected="), level).alias("rationale"),
        )

    texts = [F.lit("synthetic claim" if k == "base_claim" else "synthetic").alias(k) for k in INTERACTION_TEXTS]
    pair = F.struct(
        shot.alias("branch_a_edit_ids"), shot.alias("branch_b_edit_ids"), combined.alias("combined_impact"), interaction.alias("interaction_type"),
        F.when(interaction == "creates_new_conflict", "prerequisite_loss").alias("conflict_type"), *texts, seen.alias("evidence"), F.lit(1.0).alias("confidence"),
    )
    return F.to_json(F.struct(impact("branch_a", a).alias("branch_a_impact"), impact("branch_b", b).alias("branch_b_impact"), combined.alias("combined_impact"), F.array(pair).alias("interactions"), F.lit(1.0).alias("overall_confidence"), F.lit("dry-run").alias("notes")))


def quarantine(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Sound rows and refused rows (with a column ``problem``)."""
    judged = rows.withColumn("problem", problem)
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null")


def apply_script(lines: DataFrame, script: DataFrame) -> DataFrame:
    """Lines after an edit script: DELETE drops, REPLACE and WEAKEN swap the text if a replacement exists."""
    joined = lines.join(script, ["name", "branch", "line_index"], "left").where(F.coalesce("edit", F.lit("KEEP")) != "DELETE")
    swap = F.col("edit").isin("REPLACE", "WEAKEN") & F.col("replacement").isNotNull()
    return joined.select("name", "branch", "line_index", F.when(swap, F.col("replacement")).otherwise(F.col("text")).alias("text"))


def surviving_positions(lines: DataFrame) -> DataFrame:
    """Position of each surviving line in its branch; its line_index stays its identity."""
    w = W.partitionBy("name", "branch").orderBy("line_index")
    return lines.withColumn("branch_position", (F.row_number().over(w) - 1).cast("long"))


def best_marked(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """For each text the name with most contained phrases; the first name wins ties, none without a hit.

    ``phrases`` (name, ord, phrase) is a small fixed list and is broadcast.
    """
    hits = texts.join(F.broadcast(phrases), F.contains(texts["text"], phrases["phrase"]))
    counts = hits.groupBy("text_id", "name", "ord").agg(F.count("*").alias("hits"))
    best = counts.groupBy("text_id").agg(F.max_by("name", F.struct(F.col("hits"), -F.col("ord"))).alias("name"), F.max("hits").alias("hits"))
    return texts.select("text_id").join(best, "text_id", "left")
