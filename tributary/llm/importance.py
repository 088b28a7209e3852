"""Importance resampling towards a target's hashed word n-grams, counted once for each distinct line.

Line breaks separate words, so the features of a text are those of its lines
plus the bigrams across its line ends.  Lines repeat (licences, menus, copies):
the features of each distinct line are found once and count as often as the line
occurs; the cross-line bigrams, two words each, are kept with their document.
The same tables then give every document's weight: a line's gain is summed once
and joined to the documents that hold it.

Lines that fill more than one part in ``HOT_PARTS`` of all lines, so fewer than
``HOT_PARTS`` of them, are broadcast; no key of the join that is left has more
rows than that share.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.ordered import numbered

from .common import LOWER, cut, pieces, text_bytes, unused

N_BUCKETS = 10_000
HOT_PARTS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Words longer than this are hashed one by one.
_LONG = 64

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def _crc_table() -> np.ndarray:
    """Change of a CRC-32 register for each value of its low byte (the polynomial of zlib)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def _shift_tables() -> np.ndarray:
    """[n, byte, value]: the register's part after n zero bytes; shifts are linear, so parts add by XOR."""
    state = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
    out = [state]
    for _ in range(_LONG + 1):
        state = _TABLE[state & 0xFF] ^ (state >> 8)
        out.append(state)
    return np.stack(out)


_SHIFT = _shift_tables()


def _joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings end to end from their own, ``size`` the bytes of the right one."""
    out = right.copy()
    for b in range(4):
        out ^= _SHIFT[size, b, (left >> np.uint32(8 * b)) & np.uint32(0xFF)]
    return out


def _word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words advanced by one byte at a time."""
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    longest = np.searchsorted(-sizes[order], -np.arange(1, _LONG + 1), side="right")  # words of k bytes or more
    for k, active in enumerate(longest):
        if not active:
            break
        rows = order[:active]
        register = state[rows]
        state[rows] = _TABLE[(register ^ data[starts[rows] + k]) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > _LONG):
        state[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return state


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows given as UTF-8 bytes end to end: the lower-cased bytes, each word's row, first byte and size."""
    data = LOWER[data]
    inside = np.concatenate([[False], _WORD[data], [False]])
    rise = inside[1:] & ~inside[:-1]
    fall = inside[:-1] & ~inside[1:]
    border = offsets[1:-1]
    joined = border[inside[border] & inside[border + 1]]  # word bytes on both sides of two rows' border
    rise[joined] = fall[joined] = True
    starts = np.flatnonzero(rise)
    return data, np.searchsorted(offsets, starts, side="right") - 1, starts, np.flatnonzero(fall) - starts


def line_features(data: np.ndarray, offsets: np.ndarray, n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row, its bucket, and the bucket of the pair that ends with it, -1 for a row's first word."""
    data, row, starts, sizes = word_spans(data, offsets)
    crc = _word_crcs(data, starts, sizes)
    pair = np.full(len(starts), -1, np.int32)
    after = np.flatnonzero(row[1:] == row[:-1]) + 1
    brief = after[sizes[after] <= _LONG]
    space = _joined(crc[brief - 1], np.full(len(brief), zlib.crc32(b" "), np.uint32), np.ones(len(brief), np.int64))
    pair[brief] = _joined(space, crc[brief], sizes[brief]) % np.uint32(n_buckets)
    for i in after[sizes[after] > _LONG]:
        pair[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], zlib.crc32(b" ", int(crc[i - 1]))) % n_buckets
    return row, (crc % np.uint32(n_buckets)).astype(np.int32), pair


def _key(line: bytes) -> bytes:
    """128 bits that stand for a line."""
    return hashlib.blake2b(line, digest_size=16).digest()


def _lists(flat: np.ndarray, row: np.ndarray, n: int, kind) -> pa.Array:
    bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(kind)))


def _merged(words: np.ndarray, pairs: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and pairs with their rows, row by row."""
    flat = np.stack([words, pairs], 1).ravel()
    both = np.repeat(row, 2)
    return flat[flat >= 0], both[flat >= 0]


def distinct_lines(docs: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(key, n, buckets): each distinct line that has a word, its occurrences, the buckets of its features."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "line"):
                data, offsets = text_bytes(part.column(0))
                row, word, pair = line_features(data, offsets, n_buckets)
                flat, rows = _merged(word, pair, row)
                held = np.unique(row)
                keys = pa.array([_key(data[offsets[i] : offsets[i + 1]].tobytes()) for i in held], pa.binary())
                lists = _lists(flat, np.searchsorted(held, rows), len(held), np.int32)
                counts = part.column(1).take(pa.array(held))
                yield pa.RecordBatch.from_arrays([keys, counts, lists], ["key", "n", "buckets"])

    return lines.mapInArrow(run, "key binary, n long, buckets array<int>")


def document_lines(docs: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, keys, buckets): a document's lines that have a word, in order, and the buckets of its cross-line bigrams."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_bytes(part.column(2))
                breaks = np.flatnonzero(data == 10)
                # Each line is a row of its own; its document is found by its first byte.
                first = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
                first = first[first <= len(data)]
                ends = np.concatenate([first[1:], [len(data)]])
                doc = np.searchsorted(offsets[:-1], first, side="right") - 1
                # A break that ends its document opens an empty line, which holds no word.
                lower, row, start, sizes = word_spans(data, np.concatenate([first, [len(data)]]))
                held = np.unique(row)
                keys = [_key(data[first[i] : ends[i] - (ends[i] > first[i] and data[ends[i] - 1] == 10)].tobytes()) for i in held]
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                owner = doc[row[head]] if len(row) else np.zeros(0, np.int64)
                across = np.flatnonzero(owner[1:] == owner[:-1]) + 1
                cross = np.zeros(len(across), np.int32)
                for k, i in enumerate(across):
                    a, b = head[i] - 1, head[i]
                    words = lower[start[a] : start[a] + sizes[a]].tobytes() + b" " + lower[start[b] : start[b] + sizes[b]].tobytes()
                    cross[k] = zlib.crc32(words) % n_buckets
                n = part.num_rows
                bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                n_words = pa.array(np.bincount(doc[row], minlength=n).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys, pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n_words, lists, _lists(cross, owner[across], n, np.int32)], ["row", "doc_id", "n_words", "keys", "buckets"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, keys array<binary>, buckets array<int>")


def bucket_counts(buckets: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n) from rows of (n, buckets): each list counts n times; one vector of counts for each task."""

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = np.asarray(lists.values), np.diff(np.asarray(lists.offsets))
            first = int(lists.offsets[0].as_py())
            np.add.at(total, flat[first : first + sizes.sum()], np.repeat(np.asarray(batch.column(0)), sizes))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["bucket", "n"])

    return buckets.select("n", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def counts_vector(counts: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """The counts of all buckets on the driver: as many numbers as there are buckets, whatever the corpus."""
    out = np.zeros(n_buckets, np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, target over source, floored."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], np.int64)


def _valued(df: DataFrame, gain: np.ndarray, *kept: str) -> DataFrame:
    """The kept columns with the lists' summed gains and sizes."""

    def run(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            bounds = np.asarray(lists.offsets).astype(np.int64)
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[np.asarray(lists.values)])])
            columns = [*batch.columns[: len(kept)], pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "gain", "n_features"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, "buckets").mapInArrow(run, f"{kinds}, gain long, n_features long")


def weights(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(doc_id, n_features, n_words, weight) for every row of ``docs``.

    ``target`` has a column text.  Null texts have no features and weight 0, as
    texts without a word have; rows that repeat an id are judged one by one.
    The weight is the floored mean of the gains over the features.
    """
    lines = cut(distinct_lines(docs, n_buckets))
    held = cut(document_lines(docs, n_buckets))
    own = bucket_counts(lines, n_buckets).unionAll(bucket_counts(held.select(F.lit(1).cast("long").alias("n"), "buckets"), n_buckets))
    aims = target.select(F.lit(1).alias("doc_id"), "text")
    wanted = bucket_counts(distinct_lines(aims, n_buckets), n_buckets).unionAll(
        bucket_counts(document_lines(aims, n_buckets).select(F.lit(1).cast("long").alias("n"), "buckets"), n_buckets)
    )
    total = [counts_vector(c.groupBy("bucket").agg(F.sum("n").alias("n")), n_buckets) for c in (own, wanted)]
    gain = gains(*total)

    values = cut(_valued(lines, gain, "key", "n"))
    share = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_PARTS
    value = values.select("key", "gain", "n_features")
    marked = held.select("row", F.explode("keys").alias("key")).join(F.broadcast(value.where(values["n"] > share)), "key", "left")
    hot = F.col("n_features").isNotNull()
    rare = marked.where(~hot).select("row", "key").join(value.where(values["n"] <= share), "key")
    none = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_words")]
    columns = ["row", "gain", "n_features"]
    parts = marked.where(hot).select(*columns, *none).unionAll(rare.select(*columns, *none))
    # One row of the document itself, with its cross-line features.
    parts = parts.unionAll(_valued(held, gain, "row", "doc_id", "n_words").select(*columns, "doc_id", "n_words"))
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("gain", "n_features", "n_words")])
    floored = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    return sums.select("doc_id", "n_features", "n_words", floored.cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise fixed by seed and id, floored; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row; ``rank`` is null where the row is not drawn.

    Weight plus Gumbel noise is the score, so the highest scores are a draw
    without replacement by importance.  Of N rows with ``min_words`` words
    floor(percent * N / 100) are drawn; ties go to the smaller id (null first),
    then to fewer features.  Ranks come from ranges of scores, not from one task.
    """
    judged = cut(weights(docs, target, n_buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = judged.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = numbered(able, [F.desc("score"), "doc_id", "n_features"], "rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return ranked.select(*columns, rank).unionAll(judged.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
