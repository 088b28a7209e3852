"""Exact Jaccard similarity of word shingles, and candidates by their rarest shingles.

Texts with equal shingle sets are one class.  Two sets with similarity ``s`` or
more share a key among the first ``n - ceil(s * n) + 1`` of each in any common
order of the keys, so classes meet through those prefixes alone and no pair is
missed.  Keys that are frequent in a bounded sample come last in the order; the
sample decides how many candidates there are, never the result.  Classes that
are connected already are no candidates for each other.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, among, cut, discard, pieces, span_hashes, text_bytes

SPACE = np.zeros(256, bool)
SPACE[list(SPACES.encode())] = True
HASH_BITS = 56


def shingles(text: str | None, shingle: int) -> set[bytes]:
    """Word shingles of one text; a shorter text is one shingle, a blank one has none."""
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + shingle]) for i in range(max(1, len(parts) - shingle + 1))} if parts else set()


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(28))


def _spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; no word crosses a row."""
    n = len(data)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, span_hashes(LOWER[data], starts, np.flatnonzero(last) + 1)


def keyed(text: pa.Array, shingle: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct shingles of each text, ordered by row and key.

    The upper bits of a key hold the shingle's count in ``frequent`` (hashes in
    order, counts), the lower ones its hash.
    """
    data, offsets = text_bytes(text)
    starts, hashes = _spaced_words(data, offsets)
    row = np.searchsorted(offsets[1:], starts, side="right")
    counts = np.bincount(row, minlength=len(text))
    firsts = np.cumsum(counts) - counts
    rows, keys = [], []
    for length in range(1, shingle + 1):
        if length < shingle:
            at = firsts[counts == length]
        else:
            at = np.arange(max(0, len(hashes) - shingle + 1))
            at = at[row[at] == row[at + shingle - 1]]
        with np.errstate(over="ignore"):
            h = np.full(len(at), length, np.uint64)
            for i in range(length):
                h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i]
        rows.append(row[at])
        keys.append(_mixed(h) >> np.uint64(64 - HASH_BITS))
    row, key = np.concatenate(rows), np.concatenate(keys).astype(np.int64)
    known, often = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        key |= np.where(known[at] == key, np.minimum(often[at], 127), 0) << HASH_BITS
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[fresh], key[fresh]


def _sizes_and_digests(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, digest and first position of each row's set."""
    n = np.bincount(row, minlength=rows)
    stops = np.cumsum(n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(_mixed(key.view(np.uint64) + np.uint64(1)), out=total[1:])
        digest = _mixed(total[stops] - total[stops - n] + n.astype(np.uint64))
    return n, digest.view(np.int64), stops - n


def frequent_shingles(docs: DataFrame, shingle: int, sample_size: int, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles that a sample of documents holds most often."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = docs.count()
    if not n:
        return none

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(keyed(part.column(0), shingle, none)[1])], ["key"])

    sample = docs.select("text").sample(min(1.0, sample_size / n), seed=7)
    counted = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "key").limit(most).toPandas().sort_values("key")
    return top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def _ratio(similarity: float) -> tuple[int, int]:
    ratio = Fraction(similarity).limit_denominator(1000)
    return ratio.numerator, ratio.denominator


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def set_prints(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """64-bit SimHash of each row's set of keys; an empty set gives zero."""
    n = np.bincount(row, minlength=rows)
    out = np.zeros(rows, np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        hashes = _mixed((key.view(np.uint64) & np.uint64((1 << HASH_BITS) - 1)) * np.uint64(0x9E3779B97F4A7C15))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, (np.cumsum(n) - n)[filled], axis=0, dtype=np.int32)
        major = (2 * counts > n[filled, None]).astype(np.uint8)
        out[filled] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


PARITY = ("p0", "p1", "p2", "p3")
#: Bits of the parities of a set with more than WIDE_FROM keys, for which 256 tell little.
WIDE_BITS, WIDE_FROM = 2048, 128


def _parities(row: np.ndarray, key: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """``bits`` bits (a power of two) of each row's set, each the parity of the keys that fall on it, as integers.

    Two sets differ in at least as many keys as their parities in bits.
    """
    bit = (_mixed(key.view(np.uint64) & np.uint64((1 << HASH_BITS) - 1)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    odd = (np.bincount(row * bits + bit, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1).view(np.int64).reshape(rows, bits // 64)


def set_parities(row: np.ndarray, key: np.ndarray, rows: int) -> list[np.ndarray]:
    """256 bits of each row's set in four integers."""
    packed = _parities(row, key, rows, 256)
    return [np.ascontiguousarray(packed[:, i]) for i in range(4)]


def wide_parities(row: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """More bits of each large set; an empty list for the others."""
    large = n > WIDE_FROM
    number, own = np.cumsum(large) - 1, large[row]
    packed = _parities(number[row[own]], key[own], int(large.sum()), WIDE_BITS)
    bounds = np.concatenate([[0], np.cumsum(large * packed.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(packed.ravel()))


def classes(docs: DataFrame, similarity: float, shingle: int, sample_size: int = 8192) -> DataFrame:
    """(digest, first, n, fp, prefix, wide, p0 to p3) of each distinct shingle set; ``first`` is its least (doc_id, text_hash)."""
    num, den = _ratio(similarity)
    frequent = frequent_shingles(docs, shingle, sample_size)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                row, key = keyed(part.column(2), shingle, frequent)
                n, digest, first = _sizes_and_digests(row, key, part.num_rows)
                length = np.where(n > 0, n - -(-n * num // den) + 1, 0)
                kept = key[np.arange(len(key)) - first[row] < length[row]]
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prints = set_prints(row, key, part.num_rows).view(np.int64)
                arrays = [part.column(0), part.column(1), pa.array(digest), pa.array(n.astype(np.int32)), pa.array(prints), pa.ListArray.from_arrays(pa.array(bounds), pa.array(kept)), wide_parities(row, key, n)]
                arrays += [pa.array(x) for x in set_parities(row, key, part.num_rows)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "digest", "n", "fp", "prefix", "wide", *PARITY])

    sets = _rows(docs).mapInArrow(run, "doc_id long, text_hash long, digest long, n int, fp long, prefix array<long>, wide array<long>, p0 long, p1 long, p2 long, p3 long")
    return sets.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "prefix", "wide", *PARITY)])


def _near(unlike, both, num: int, den: int):
    """Whether sets with ``both`` keys in all that differ in ``unlike`` at least can have the similarity."""
    return (both - unlike) * (num + den) >= 2 * num * both


def likely(classes: DataFrame, listed: DataFrame, similarity: float) -> DataFrame:
    """The rows (node, root) of ``listed`` that the wide parities leave; no pair with the similarity is left out."""
    ends = listed.select(F.explode(F.array("node", "root")).alias("end"))
    sets = among(classes.select("digest", "n", "wide"), ["digest"], ends, ["end"])
    met = listed.join(sets.toDF("node", "a", "left"), "node").join(sets.toDF("root", "b", "right"), "root")
    unlike = F.aggregate(F.zip_with("left", "right", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = _near(unlike, (F.col("a") + F.col("b")).cast("long"), *_ratio(similarity))
    return met.where((F.size("left") != F.size("right")) | near).select("node", "root")


def verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The rows (node, root) of ``candidates`` whose texts have the similarity, by their shingles as text; written once."""
    num, den = _ratio(similarity)
    listed = cut(candidates.select("node", "root").distinct())
    wanted = cut(likely(classes, listed, similarity))
    named = wanted.select(F.explode(F.array("node", "root")).alias("digest")).distinct().join(classes.select("digest", "first"), "digest")
    named = cut(named.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")))
    rows = among(_rows(docs), ["doc_id", "text_hash"], named, ["first_id", "first_hash"])
    same = (rows["doc_id"] == named["first_id"]) & (rows["text_hash"] == named["first_hash"])
    texts = cut(rows.join(named, same).select("digest", "text").dropDuplicates(["digest"]))

    def compared(batches):
        for batch in batches:
            node, root, left, right = (batch.column(i) for i in range(4))
            alike, last, other = [], None, set()
            for a, b in zip(left, right):
                a, b = shingles(a.as_py(), shingle), b.as_py()
                if b != last:
                    last, other = b, shingles(b, shingle)
                both = len(a & other)
                alike.append(both * den >= (len(a) + len(other) - both) * num)
            keep = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([node.filter(keep), root.filter(keep)], ["node", "root"])

    joined = wanted.join(texts.toDF("node", "left_text"), "node").join(texts.toDF("root", "right_text"), "root")
    out = cut(joined.select("node", "root", "left_text", "right_text").mapInArrow(compared, "node long, root long"))
    discard(listed, wanted, named, texts)
    return out


def shared_entries(classes: DataFrame) -> DataFrame:
    """(key, digest, pos, n, p0 to p3) of the prefix keys that more than one class holds, written once."""
    entries = classes.select("digest", F.posexplode("prefix").alias("pos", "key"))
    keys = entries.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("key")
    keys = cut(keys)
    out = cut(entries.join(keys, "key", "left_semi").join(classes.select("digest", "n", *PARITY), "digest"))
    discard(keys)
    return out


def open_entries(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``shared_entries`` on keys that more than one component holds, with their component, written once."""
    entries = shared.join(roots.toDF("digest", "root"), "digest", "left").withColumn("comp", F.coalesce("root", "digest")).drop("root")
    keys = cut(entries.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"))
    out = cut(entries.join(keys, "key", "left_semi"))
    discard(keys)
    return out


def _may_link(num: int, den: int):
    least = F.least(F.col("a.n"), F.col("b.n")) * den >= F.greatest(F.col("a.n"), F.col("b.n")) * num
    # The first common key leaves at most the rest of either set to share.
    shared = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    enough = shared.cast("long") * (num + den) >= (F.col("a.n") + F.col("b.n")).cast("long") * num
    both = (F.col("a.n") + F.col("b.n")).cast("long")
    unlike = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITY), F.lit(0))
    close = _near(unlike, both, num, den)
    return (F.col("a.comp") != F.col("b.comp")) & least & enough & close


def stars(entries: DataFrame, similarity: float, salt: int = 0) -> DataFrame:
    """Candidates (node, root) of each class with one class of each of its keys: as many as entries at most.

    It is the class in which the key stands first, drawn by key among equals:
    with the fewest rarer shingles of its own it is the least edited of a group
    of near copies and similar to most of them, so that one round connects them.
    """
    order = F.struct("pos", F.xxhash64("key", "digest", F.lit(salt)))
    one = entries.groupBy("key").agg(F.min_by(F.struct("digest", "comp", "n", "pos", *PARITY), order).alias("b")).select("key", "b.*")
    met = entries.alias("a").join(one.alias("b"), (F.col("a.key") == F.col("b.key")) & _may_link(*_ratio(similarity)))
    return met.select(F.col("a.digest").alias("node"), F.col("b.digest").alias("root")).distinct()


def pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """All candidates (node, root) of different components.

    In each key the component with the most entries is set apart, and the other
    entries meet all; so the entries of one large component never meet each
    other.
    """
    counts = entries.groupBy("key", "comp").agg(F.count("*").alias("rows"))
    most = counts.groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("most"))
    sided = entries.join(most, "key").withColumn("minor", F.col("comp") != F.col("most")).drop("most")
    once = ~F.col("b.minor") | (F.col("a.digest") < F.col("b.digest"))
    met = sided.where("minor").alias("a").join(sided.alias("b"), (F.col("a.key") == F.col("b.key")) & once & _may_link(*_ratio(similarity)))
    return met.select(F.greatest("a.digest", "b.digest").alias("node"), F.least("a.digest", "b.digest").alias("root")).distinct()
