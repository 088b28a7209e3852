"""Helpers shared by the corpus operators: lineage cuts and Arrow text kernels."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Characters that separate words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
_BLANK = frozenset(SPACES.encode())
_BLANK_BYTES = np.frombuffer(SPACES.encode(), np.uint8)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master; elsewhere other
    hosts would not see it, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-tributary-"))
    return context.getCheckpointDir()


#: While a table is written, Spark deletes the shuffle files of its query at the end.
_CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The table replaces the lineage, so a lost executor costs a re-read and
    nothing above the cut runs twice; the shuffle files that made it go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANING, "false")
    spark.conf.set(_CLEANING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANING, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.cut_path)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that ``cut`` has written for this application; results that still read them fail after."""
    _delete(spark, f"{shared_folder(spark)}/tables")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def among(rows: DataFrame, keys: list[str], wanted: DataFrame, wanted_keys: list[str], most_bits: int = 1 << 25) -> DataFrame:
    """The rows whose ``keys`` are among ``wanted_keys`` of ``wanted``, and a few others, for an exact join to follow.

    Bits set at the hashes of the wanted keys are broadcast (4 MB at most), so
    that wide rows which nothing wants aren't shuffled.
    """
    bits = min(most_bits, max(1 << 15, 1 << (64 * wanted.count()).bit_length()))
    bucket, marks = unused(rows, "bucket", "marks")

    def place(names: list[str]) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(bits)) + 1

    at = place(wanted_keys)
    marked = wanted.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(marks))
    at = F.bitmap_bit_position(place(keys))
    byte = F.conv(F.hex(F.substring(marks, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(bucket, F.bitmap_bucket_number(place(keys))).join(F.broadcast(marked), bucket)
    return found.where(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def words(text: Column) -> Column:
    """Maximal runs of non-space characters; null and blank texts give an empty array."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACE_CLASS + "+"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda variable is bound to the value, so the optimizer can't repeat the
    expression inside the loops that use it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20):
    """Slices of a batch with about ``max_bytes`` of text each (one row at least).

    Bounds the temporaries of vectorised kernels whatever the batch size.
    """
    text = batch.column(batch.schema.get_field_index(column))
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    offsets = text_offsets(text)
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        stop = min(rows, max(row + 1, stop))
        yield batch.slice(row, stop - row)
        row = stop


def text_offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    raw = text.buffers()[1]
    if raw is None or len(text) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(raw, kind, len(text) + 1 + text.offset)[text.offset :].astype(np.int64)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and each row's offset; nulls count as empty."""
    if text.null_count:
        text = text.fill_null("")
    offsets = text_offsets(text)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# Odd multiplier of the polynomial word hash, modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is not None and len(_powers[0]) >= n:
        return _powers
    n = max(n, 1 << 20)
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        tables = (np.cumprod(up), np.cumprod(down))
    # Tables for a longer text than usual aren't kept for the worker's life.
    if n <= 1 << 22:
        _powers = tables
    return tables


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values`` (uint8); equal spans hash alike wherever they stand."""
    n = len(values)
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = True
LETTER[128:] = True


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters (ASCII letters and all non-ASCII bytes), A-Z lower-cased.

    Returns start, end and hash of each word; no word crosses a row.
    """
    n = len(data)
    inside = LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, span_hashes(LOWER[data], starts, ends)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, of that segment's values alone; empty segments give zero."""
    out = np.zeros((len(bounds) - 1,) + values.shape[1:], np.float64)
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values[: bounds[-1]].astype(np.float64), bounds[:-1][filled], axis=0)
    return out


def fragments(data: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Consecutive parts of one text's bytes, about ``size`` each, that end after white space.

    A run without white space is never cut.
    """
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + size)
        while stop < len(data) and data[stop - 1] not in _BLANK:
            more = np.flatnonzero(np.isin(data[stop : stop + size], _BLANK_BYTES))
            stop = min(len(data), stop + (int(more[0]) + 1 if len(more) else size))
        out.append((at, stop))
        at = stop
    return out


def drawn(keys: DataFrame, sample_size: int, salt: int, by: str | None = None, floor: int = 200) -> DataFrame:
    """At most ``sample_size`` rows of ``keys`` (distinct doc_id, ...), the same on every run.

    The rows with the smallest hashes of their id are taken.  With ``by``, a
    column of few values, each value has its share of the sample by its rows,
    and ``floor`` rows at least where it has that many.
    """
    order = F.xxhash64("doc_id", F.lit(salt))
    hashed = keys.withColumn("draw", order)
    if by is None:
        return hashed.orderBy("draw", "doc_id").limit(sample_size)
    counts = {r[0]: r[1] for r in keys.groupBy(by).count().orderBy(F.desc("count"), by).limit(sample_size).collect()}
    least = max(1, min(floor, sample_size // max(1, 2 * len(counts))))
    spare, total = max(0, sample_size - least * len(counts)), sum(counts.values())
    kind = StructType([StructField(by, keys.schema[by].dataType), StructField("share", LongType())])
    shares = keys.sparkSession.createDataFrame([(value, least + spare * n // total) for value, n in counts.items()], kind)
    place = F.row_number().over(Window.partitionBy(by).orderBy("draw", "doc_id"))
    # The constant bound lets each task cut its rows before the shuffle.
    ranked = hashed.withColumn("place", place).where(F.col("place") <= sample_size)
    return ranked.join(F.broadcast(shares), by).where(F.col("place") <= F.col("share")).drop("place", "share")


def texts_of(docs: DataFrame, chosen: DataFrame, sample_bytes: int) -> DataFrame:
    """(draw, doc_id, text, ...) of the chosen ids: one row for each, ``sample_bytes`` of text in all.

    Of rows that repeat an id the text with the least hash counts.  Ids are
    taken in the order of their draw while their texts fit (one at least); the
    table is written, so the rows are read from ``docs`` once.
    """
    extra = [c for c in chosen.columns if c != "doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    single = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), *[F.first(c).alias(c) for c in extra])
    table = cut(single)
    sizes = table.select("draw", F.octet_length("text").alias("n")).orderBy("draw", "doc_id").collect()
    total, last = 0, None
    for r in sizes:
        total += r.n
        if last is not None and total > sample_bytes:
            return table.where(F.col("draw") <= last)
        last = r.draw
    return table


