"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A paragraph is a line of the text and its digest covers the line's bytes; a
section is a run of paragraphs that ends where a paragraph's digest says so,
hence an edit moves no border but its own; the root covers the sections.  Equal
roots mean equal texts.  Below a paragraph stand its phrases (up to a mark of
punctuation, or 64 bytes where none comes).

Likeness walks two trees from the root: equal branches count whole and are not
entered, the others are compared one level down, and at last their phrases.

The fingerprint is the tree written out::

    <root>:<section>=<paragraph>,<phrases>.<paragraph>,<phrases>;<section>=...

with 32 hexadecimal digits for the root, 16 for each section and paragraph and
12 for each phrase; a dot parts the paragraphs of a section.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import span_hashes, text_bytes

PHRASE_BITS = 48
DIGITS = PHRASE_BITS // 4
LONG_PHRASE = 64
SECTION_ODDS = 8
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".!?;,|\n"]] = True
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@dataclass(frozen=True)
class Tree:
    """Digests of a text's root, sections, paragraphs and phrases, and where the branches of each node begin (and the last ends)."""

    root: str
    sections: tuple[str, ...]
    section_at: tuple[int, ...]  # first paragraph of each section
    paragraphs: tuple[str, ...]
    paragraph_at: tuple[int, ...]  # first phrase of each paragraph
    phrases: np.ndarray

    def written(self) -> str:
        text, out = _hex(self.phrases), []
        for name, a, b in zip(self.sections, self.section_at, self.section_at[1:]):
            own = [f"{self.paragraphs[k]},{text[DIGITS * self.paragraph_at[k] : DIGITS * self.paragraph_at[k + 1]]}" for k in range(a, b)]
            out.append(f"{name}={'.'.join(own)}")
        return f"{self.root}:{';'.join(out)}"


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every phrase (and the end of the last), none crossing a row, and its digest."""
    n = len(data)
    cuts = np.unique(np.concatenate([np.flatnonzero(_MARK[data]) + 1, offsets])) if n else np.zeros(1, np.int64)
    lengths = np.diff(cuts)
    parts = np.where(lengths > LONG_PHRASE + LONG_PHRASE // 2, -(-lengths // LONG_PHRASE), 1)
    first = np.cumsum(parts) - parts
    starts = np.repeat(cuts[:-1], parts) + LONG_PHRASE * (np.arange(parts.sum()) - np.repeat(first, parts))
    bounds = np.append(starts, n)
    return bounds, span_hashes(data, bounds[:-1], bounds[1:]) & np.uint64((1 << PHRASE_BITS) - 1)


def _hex(digests: np.ndarray) -> str:
    """Hexadecimal digits of the phrase digests, end to end."""
    shifts = np.arange(PHRASE_BITS - 4, -1, -4, dtype=np.uint64)
    return _HEX[((digests[:, None] >> shifts) & np.uint64(15)).astype(np.uint8)].tobytes().decode("ascii")


def grown(texts: list[str]) -> list[Tree]:
    """Tree of each text."""
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    bounds, digests = phrases(data, offsets)
    rows = np.searchsorted(bounds, offsets)
    blake = hashlib.blake2b
    out = []
    for i, text in enumerate(texts):
        at = bounds[rows[i] : rows[i + 1]] - offsets[i]
        root = blake(digest_size=16)
        lines = text.encode("utf-8").split(b"\n")
        ends = np.cumsum([len(x) + 1 for x in lines])
        paragraphs = [blake(line, digest_size=8).digest() for line in lines]
        sections, section_at = [], [0]
        for k, digest in enumerate(paragraphs):
            if digest[0] % SECTION_ODDS == 0 or k == len(lines) - 1:
                section = blake(b"".join(paragraphs[section_at[-1] : k + 1]), digest_size=8).digest()
                root.update(section)
                sections.append(section.hex())
                section_at.append(k + 1)
        uses = (0, *np.searchsorted(at, ends).tolist())
        out.append(Tree(root.hexdigest(), tuple(sections), tuple(section_at), tuple(p.hex() for p in paragraphs), uses, digests[rows[i] : rows[i + 1]]))
    return out


def trees(texts: list[str]) -> tuple[list[str], list[Tree]]:
    """Fingerprint and tree of each text."""
    out = grown(texts)
    return [t.written() for t in out], out


def read_tree(fingerprint: str) -> Tree:
    """The tree that a fingerprint holds."""
    root, _, body = fingerprint.partition(":")
    sections, section_at, paragraphs, paragraph_at, leaves = [], [0], [], [0], []
    for section in body.split(";"):
        name, _, inside = section.partition("=")
        sections.append(name)
        for paragraph in inside.split("."):
            digest, _, own = paragraph.partition(",")
            paragraphs.append(digest)
            leaves += [int(own[i : i + DIGITS], 16) for i in range(0, len(own), DIGITS)]
            paragraph_at.append(len(leaves))
        section_at.append(len(paragraphs))
    return Tree(root, tuple(sections), tuple(section_at), tuple(paragraphs), tuple(paragraph_at), np.array(leaves, np.uint64))


def _unmatched(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> tuple[list[int], list[int]]:
    """Nodes (digest, number) of two sides that stay when equal digests are paired off, as numbers."""
    spare = Counter(d for d, _ in b)
    used, left = Counter(), []
    for d, i in a:
        if spare[d] > 0:
            spare[d] -= 1
            used[d] += 1
        else:
            left.append(i)
    right = []
    for d, i in b:
        if used[d] > 0:
            used[d] -= 1
        else:
            right.append(i)
    return left, right


def differing(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """Paragraphs of either tree that the other lacks; equal sections are not entered."""
    if a.root == b.root:
        return [], []
    left, right = _unmatched([*zip(a.sections, range(len(a.sections)))], [*zip(b.sections, range(len(b.sections)))])

    def inside(t: Tree, numbers: list[int]) -> list[tuple[str, int]]:
        return [(t.paragraphs[k], k) for s in numbers for k in range(t.section_at[s], t.section_at[s + 1])]

    return _unmatched(inside(a, left), inside(b, right))


def likeness(a: Tree | str, b: Tree | str) -> float:
    """Twice the common phrases over all phrases of both, found below differing branches only; 1 for equal roots.

    Takes trees or fingerprints.
    """
    a, b = (read_tree(x) if isinstance(x, str) else x for x in (a, b))
    if a.root == b.root:
        return 1.0
    whole = len(a.phrases) + len(b.phrases)
    if not whole:
        return 1.0
    left, right = differing(a, b)
    x, y = (np.concatenate([t.phrases[t.paragraph_at[k] : t.paragraph_at[k + 1]] for k in own] or [t.phrases[:0]]) for t, own in ((a, left), (b, right)))
    common = whole - len(x) - len(y)
    if len(x) and len(y):
        u, n = np.unique(x, return_counts=True)
        v, m = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        common += 2 * int(np.minimum(n[i], m[j]).sum())
    return common / whole


def differing_paragraphs(a: str, b: str) -> list[int]:
    """Paragraphs of ``a`` (from 0) that ``b`` doesn't have; equal branches are not entered."""
    return differing(read_tree(a), read_tree(b))[0]


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many of the first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _borders(rows: DataFrame, parts: int) -> list[tuple[int | None, int | None]]:
    """Where buckets end in the order of the rows, as (doc_id, hash); few, whatever the table's size.

    Borders are ranges of doc_id at quantiles.  An id that would fill more than
    one bucket, as null ids may, is divided further by its texts' hashes, which
    spread evenly.
    """
    if parts < 2:
        return []
    n, unknown = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if n > unknown else []
    edges = [int(x) for x in cuts]
    full = n / parts

    def divided(doc_id: int | None, pieces: int) -> list[tuple[int | None, int | None]]:
        return [(doc_id, -(1 << 63) + (i << 64) // pieces) for i in range(1, pieces)]

    out: list[tuple[int | None, int | None]] = []
    for edge in sorted(set(edges), reverse=True):
        out += divided(edge, edges.count(edge)) + [(edge, None)]
    return out + divided(None, -(-unknown // max(1, int(full))))


def beside_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, tail, doc_id, hash, text), partitioned by bucket in descending order of doc_id.

    The first row of each bucket is sent to the bucket before as its tail (that
    of the first to the last), so every row finds its successor without a
    global sort or window.  Ties are ordered by their text's hash; null ids come
    last.  Rows that repeat both id and text share a bucket.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    borders = _borders(named, parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    low = -(1 << 63)
    # Ids descend, so they are compared by their complement; null comes after all.
    ends = np.array([(1, 0, h) if i is None else (0, ~i, (1 << 63) - 1 if h is None else h) for i, h in borders], np.int64).reshape(-1, 3)

    def bucket_of(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        key = np.stack([(~known).astype(np.int64), np.where(known, ~ids.fill_null(0).to_numpy(), 0), hashes.fill_null(low).to_numpy()], 1)
        every = np.concatenate([ends, key])
        order = np.lexsort((np.arange(len(every)) < len(ends), every[:, 2], every[:, 1], every[:, 0]))
        passed = np.cumsum(order < len(ends))
        out = np.empty(len(every), np.int64)
        out[order] = passed
        return out[len(ends) :]

    def heads(batches):
        for batch in batches:
            bucket = bucket_of(batch.column(0), batch.column(1))
            own = pa.table({"bucket": bucket, "unknown": pa.compute.is_null(batch.column(0)), "doc_id": batch.column(0), "hash": batch.column(1)})
            own = own.sort_by([("bucket", "ascending"), ("unknown", "ascending"), ("doc_id", "descending"), ("hash", "ascending")])
            first = np.flatnonzero(np.append(True, np.diff(own.column("bucket").to_numpy()) != 0)) if len(own) else []
            yield from own.take(pa.array(first, pa.int64())).to_batches()

    first_of = F.min(F.struct("unknown", (-1 - F.col("doc_id")).alias("order"), "hash", "doc_id"))
    found = rows.select("doc_id", "hash").mapInArrow(heads, "bucket long, unknown boolean, doc_id long, hash long").groupBy("bucket").agg(first_of.alias("top")).collect()
    tops = {r.bucket: (r.top.doc_id, r.top.hash) for r in found}
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    count = len(borders) + 1

    def dealt(batches):
        sent = set()
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            own = bucket_of(ids, hashes)
            plain = [pa.array(own.astype(np.int32)), pa.array(np.zeros(len(own), bool)), *batch.columns]
            yield pa.RecordBatch.from_arrays(plain, ["bucket", "tail", "doc_id", "hash", "text"])
            pick = []
            top_hash = np.array([tops[b][1] for b in own.tolist()], np.int64)
            for i in np.flatnonzero(hashes.to_numpy() == top_hash).tolist():
                b = int(own[i])
                # Rows that equal the first are alike, so a task sends one of them.
                if b not in sent and tops[b][0] == ids[i].as_py():
                    sent.add(b)
                    pick.append(i)
            if pick:
                to = pa.array(np.array([before[int(own[i])] for i in pick], np.int32))
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(pick), bool)), *batch.take(pa.array(pick)).columns], ["bucket", "tail", "doc_id", "hash", "text"])

    # Buckets are of even size, so each is a partition of its own.
    out = rows.mapInArrow(dealt, "bucket int, tail boolean, doc_id long, hash long, text string").repartitionById(count, F.col("bucket"))
    return out.sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "hash", "text")


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses.

    Null texts count as empty, and two empty texts are alike (1).  A single
    document follows itself.  Repeated rows stay repeated, each followed by the
    next copy; columns besides doc_id and text are not read.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(ids, texts, following):
        changed = [edited(a, b) for a, b in zip(texts, following)]
        n = len(texts)
        # Successors are in the same block but for the last.
        found = grown([*texts, following[-1], *changed])
        after = [i + 1 if i + 1 < n and following[i] is texts[i + 1] else None for i in range(n)]
        near_edited, near_next = [], []
        for i in range(n):
            near_edited.append(likeness(found[i], found[n + 1 + i]))
            near_next.append(likeness(found[i], found[after[i] if after[i] is not None else n]))
        prints = [t.written() for t in found]
        arrays = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], pa.string()),
            pa.array(prints[:n], pa.string()), pa.array(prints[n + 1 :], pa.string()), pa.array(near_edited), pa.array(near_next),
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        ids, texts, following, size = [], [], [], 0
        waiting = None  # (bucket, doc_id, text) without a successor so far
        for batch in batches:
            for bucket, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if waiting and waiting[0] == bucket:
                    ids.append(waiting[1])
                    texts.append(waiting[2])
                    following.append(text)
                    size += len(waiting[2])
                    # A block ends where the chain of successors does.
                    if tail or size > 1 << 20:
                        yield block(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
                waiting = None if tail else (bucket, doc_id, text)
        if texts:
            yield block(ids, texts, following)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs, parts).mapInArrow(run, schema)


def op9_merkle(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
