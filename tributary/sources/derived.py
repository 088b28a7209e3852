"""Merge tables derived from the given tables.

A conversation is a BASE video whose turns are shots; two branches are derived
from it by an edit script that a hash of (merge, shot, branch) decides:
0 delete, 1 replace, 2 trim to the first four fifths, 3 insert a shot after,
else keep.  Visual features come from the embeddings, replacement wording from
the benchmark items.  The edit script is the ground truth of the alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions import text as T

BRANCHES = ("branch_a", "branch_b")
SECONDS_PER_WORD = 0.4


def draw(*parts: Column) -> Column:
    """A number below 2**28 from the md5 of the parts."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec, hash, rgb, hist): 64 sign bits as hexadecimal, three means clipped to [0, 1], twelve bins summing to 1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def digit(i: Column) -> Column:
        bit = lambda k: F.when(F.element_at("e", 4 * i + k) > 0, 1).otherwise(0)
        return F.lower(F.hex(bit(1) * 8 + bit(2) * 4 + bit(3) * 2 + bit(4)))

    def mean(start: int, n: int) -> Column:
        total = F.aggregate(F.slice("e", start, n), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + total / float(n)))

    first = F.transform(F.slice("e", 1, 12), F.abs)
    total = F.aggregate(first, F.lit(0.0), lambda s, x: s + x)
    return e.select(
        F.col("vec_id").alias("vec"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), digit), "").alias("hash"),
        F.array(mean(1, 21), mean(22, 21), mean(43, 22)).alias("rgb"),
        F.transform(first, lambda x: x / total).alias("hist"),
    )


def _timed(rows: DataFrame, keys: list[str], order: list[str], index: str) -> DataFrame:
    """Index and start/end seconds of shots from their word counts."""
    w = W.partitionBy(*keys).orderBy(*order)
    done = F.sum("n_words").over(w.rowsBetween(W.unboundedPreceding, 0))
    return (
        rows.withColumn(index, (F.row_number().over(w) - 1).cast("long"))
        .withColumn("start", (done - F.col("n_words")) * F.lit(SECONDS_PER_WORD))
        .withColumn("end", done * F.lit(SECONDS_PER_WORD))
        .withColumn("duration", F.col("n_words") * F.lit(SECONDS_PER_WORD))
    )


def base_shots(spark: SparkSession, sf_dir: str, conversations: str | None = None) -> DataFrame:
    """(merge_id, base_index, text, n_words, start, end, duration, vec) for every turn."""
    turns = spark.read.parquet(conversations or f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("merge_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rows = turns.withColumn("n_words", T.word_count(F.col("text")).cast("long"))
    timed = _timed(rows, ["merge_id"], ["turn", "text"], "base_index")
    return timed.withColumn("vec", (F.col("merge_id") * 8 + F.col("base_index")) % n).drop("turn")


def edit_script(base: DataFrame) -> DataFrame:
    """(merge_id, base_index, branch, draw, edit): what each branch does to each BASE shot."""
    names = F.explode(F.array(*map(F.lit, BRANCHES)))
    rows = base.select("merge_id", "base_index", names.alias("branch"))
    rows = rows.withColumn("draw", draw(F.col("merge_id"), F.col("base_index"), F.col("branch")))
    kind = F.col("draw") % 10
    return rows.withColumn("edit", F.when(kind == 0, "delete").when(kind == 1, "replace").when(kind == 2, "trim").when(kind == 3, "insert_after").otherwise("keep"))


def branch_shots(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """(merge_id, branch, branch_index, base_index, sub, text, n_words, start, end, duration, vec); sub is 1 for inserted shots."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    k = items.count()
    wording = items.select(F.col("item_id").alias("item"), F.col("text").alias("item_text"))
    rows = base.select("merge_id", "base_index", "text", "n_words", "vec").join(edit_script(base), ["merge_id", "base_index"])
    rows = rows.withColumn("item", F.floor(F.col("draw") / 10) % k).join(wording, "item")
    trimmed = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^ \t-\r]+"), F.lit(0)), F.lit(1), F.floor(F.col("n_words") * 4 / 5).cast("int")), " ")
    other = F.floor(F.col("draw") / 7) % n
    moved = (F.col("edit") == "replace") & (F.floor(F.col("draw") / 1000) % 2 == 0)
    own = rows.where("edit <> 'delete'").select(
        "merge_id", "branch", "base_index", F.lit(0).alias("sub"),
        F.when(F.col("edit") == "replace", F.col("item_text")).when(F.col("edit") == "trim", trimmed).otherwise(F.col("text")).alias("text"),
        F.when(moved, other).otherwise(F.col("vec")).alias("vec"),
    )
    extra = rows.where("edit = 'insert_after'").select("merge_id", "branch", "base_index", F.lit(1).alias("sub"), F.col("item_text").alias("text"), other.alias("vec"))
    joint = own.unionByName(extra).withColumn("n_words", T.word_count(F.col("text")).cast("long"))
    return _timed(joint, ["merge_id", "branch"], ["base_index", "sub"], "branch_index")


def fingerprints(shots: DataFrame, feature_rows: DataFrame) -> DataFrame:
    """Shots with hash, rgb, hist, normalized transcript, tokens, token bag and has_speech."""
    rows = shots.join(feature_rows, "vec").withColumn("normalized", T.normalize(F.col("text")))
    rows = rows.withColumn("tokens", T.tokens(F.col("normalized"))).withColumn("has_speech", F.col("normalized") != "")
    return rows.withColumn("bag", T.bag(F.col("tokens")))
