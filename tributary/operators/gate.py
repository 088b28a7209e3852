"""Transcript gate: recognised wording against expected wording, marker by marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import config
from tributary.functions import text as T


def markers(spark: SparkSession) -> DataFrame:
    """(category, marker, parts): the fixed marker phrases, tokenised like any text."""
    rows = [(c, m) for c, phrases in config.MARKERS.items() for m in phrases]
    return spark.createDataFrame(rows, "category string, marker string").withColumn("parts", T.gate_tokens(F.col("marker")))


def judged(shots: DataFrame) -> DataFrame:
    """Shots (fixture, branch, shot_no, expected, recognized) with token similarity."""
    rows = shots.withColumn("expected", F.coalesce("expected", F.lit(""))).withColumn("recognized", F.coalesce("recognized", F.lit("")))
    rows = rows.withColumn("e", F.array_distinct(T.gate_tokens(F.col("expected")))).withColumn("r", F.array_distinct(T.gate_tokens(F.col("recognized"))))
    return rows.withColumn("similarity", T.set_jaccard(F.col("e"), F.col("r")))


def missing_markers(rows: DataFrame) -> DataFrame:
    """(fixture, branch, shot_no, category, marker): markers the expected wording has and the recognised one lacks.

    The marker list is fixed and small (bounded by the configuration), so it is
    broadcast to the shots.
    """
    dim = F.broadcast(markers(rows.sparkSession))

    def inside(column: str) -> Column:
        return F.size(F.array_except(F.col("parts"), F.col(column))) == 0

    return rows.join(dim, inside("e") & ~inside("r")).select("fixture", "branch", "shot_no", "category", "marker")


def video_rollup(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """Average and least similarity of each video and its shots with missing markers, by category count."""
    keys = ["fixture", "branch"]
    flagged = missing.select(*keys, "shot_no", "category").distinct().groupBy(*keys).agg(F.count("*").alias("flagged"), F.countDistinct("category").alias("categories"))
    sims = rows.groupBy(*keys).agg(F.count("*").alias("shots"), F.avg("similarity").alias("avg_similarity"), F.min("similarity").alias("min_similarity"))
    return sims.join(flagged, keys, "left").fillna(0, ["flagged", "categories"])


def fixture_rollup(videos: DataFrame, rows: DataFrame) -> DataFrame:
    """Eligibility of each fixture: no shot below the soft floor and no marker missing; warnings for the band above it."""
    soft = rows.groupBy("fixture").agg(F.count_if(F.col("similarity").between(config.GATE_SOFT_FLOOR, config.GATE_THRESHOLD) & (F.col("similarity") < config.GATE_THRESHOLD)).alias("soft_warnings"))
    f = videos.groupBy("fixture").agg(F.min("min_similarity").alias("min_similarity"), F.sum("flagged").alias("flagged"), F.count("*").alias("videos"))
    clean = F.col("min_similarity") >= config.GATE_SOFT_FLOOR
    whole = F.col("flagged") == 0
    return f.join(soft, "fixture").select("fixture", "videos", "min_similarity", "flagged", "soft_warnings", clean.alias("soft_clean"), whole.alias("semantically_clean"), (clean & whole).alias("eligible"))


def disqualify_reasons(videos: DataFrame, missing: DataFrame) -> DataFrame:
    """(fixture, branch, category, shots, reason): why a fixture may not be evaluated, one row for each video and cause."""
    low = videos.where(F.col("min_similarity") < config.GATE_SOFT_FLOOR)
    worst = F.format_string(f"%s: min per-shot similarity %.2f < soft floor {config.GATE_SOFT_FLOOR:.2f} (catastrophic transcript loss)", "branch", F.round("min_similarity", 2))
    lost = missing.select("fixture", "branch", "shot_no", "category").distinct().groupBy("fixture", "branch", "category").agg(F.count("*").alias("shots"))
    broken = F.format_string("%s: missing %s markers (%d shots) — semantic integrity broken", "branch", "category", "shots")
    none = F.lit(None)
    return low.select("fixture", "branch", none.cast("string").alias("category"), none.cast("long").alias("shots"), worst.alias("reason")).unionByName(lost.withColumn("reason", broken))


def soft_warnings(rows: DataFrame) -> DataFrame:
    """(fixture, branch, shot_no, warning): shots between the soft floor and the threshold; their fixture stays eligible."""
    floor, limit = config.GATE_SOFT_FLOOR, config.GATE_THRESHOLD
    text = F.format_string(f"%s shot_%04d: similarity %.2f in [{floor:.2f}, {limit:.2f}) — soft warning, lexical noise but no semantic-marker loss", "branch", "shot_no", F.round("similarity", 2))
    return rows.where((F.col("similarity") >= floor) & (F.col("similarity") < limit)).select("fixture", "branch", "shot_no", text.alias("warning"))


def by_ordinal(shots: DataFrame, script: DataFrame) -> DataFrame:
    """(fixture, branch, shot_no, expected, recognized): each recognised shot beside the script's line of the same number.

    ``shots`` has fixture, branch, shot_no, text and ``script`` fixture, branch,
    line_no, text.  A shot beyond the script's end is expected to say nothing; a
    line without a shot gives no row.
    """
    said = shots.select("fixture", "branch", "shot_no", F.coalesce("text", F.lit("")).alias("recognized"))
    lines = script.select("fixture", "branch", F.col("line_no").alias("shot_no"), F.col("text").alias("line"))
    return said.join(lines, ["fixture", "branch", "shot_no"], "left").select("fixture", "branch", "shot_no", F.coalesce("line", F.lit("")).alias("expected"), "recognized")


def category_sums(missing: DataFrame) -> DataFrame:
    """(fixture, category, shots): shots of all its videos that lack a marker of the category."""
    return missing.select("fixture", "branch", "shot_no", "category").distinct().groupBy("fixture", "category").agg(F.count("*").alias("shots"))


def require_eligible(fixtures: DataFrame, reasons: DataFrame, path: str) -> DataFrame:
    """The fixtures, if all may be evaluated; the report is written to ``path`` in any case, then an ineligible one raises ValueError."""
    listed = reasons.groupBy("fixture").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    fixtures.join(listed, "fixture", "left").write.mode("overwrite").json(path)
    refused = fixtures.where("not eligible").count()
    if refused:
        raise ValueError(f"{refused} fixtures are not eligible for evaluation; see {path}")
    return fixtures


def derived_gate_shots(base: DataFrame, branch: DataFrame, rows: DataFrame) -> DataFrame:
    """BASE wording as expected, the aligned branch wording as recognised; surplus shots expect nothing."""
    aligned = rows.where("branch_index is not null").select("merge_id", "branch", "base_index", "branch_index")
    said = aligned.join(branch.select("merge_id", "branch", "branch_index", F.col("text").alias("recognized")), ["merge_id", "branch", "branch_index"])
    joined = said.join(base.select("merge_id", "base_index", F.col("text").alias("expected")), ["merge_id", "base_index"], "left")
    return joined.select(F.col("merge_id").alias("fixture"), "branch", F.col("branch_index").alias("shot_no"), "expected", "recognized")
