"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

1. Each text becomes a 64-bit SimHash of its word shingles.
2. Documents with equal fingerprints collapse to one class before anything is
   compared, so groups of exact copies never meet in pairs.
3. Classes are partitioned by Hamming distance with vantage-point trees.  Two
   fingerprints within ``radius`` differ by at most ``radius // bands`` bits in
   one of ``bands`` bit ranges, so one tree per range with that smaller reach
   finds every pair; the smaller the reach, the more the triangle bound prunes.
   A fingerprint has one home shard in each tree and visits the shards whose
   region overlaps its ball.
4. Shards compare home rows with home rows and visitors over all 64 bits and
   return for each row one link into its group, never all pairs.  A shard with
   many rows is parted again by a tree of its own, and cut into blocks beyond
   ``block_rows``.
5. Links are contracted to components with alternating large and small stars;
   each round is written to the shared folder.

The trees are fitted on a bounded sample (``sample_size`` fingerprints); every
row is routed and compared, and the result is exact for any tree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_join
from .common import cut, discard, pieces, unused
from .components import components

SEED = 42


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text: majority of the bits of its shingles' XXH64."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - shingle].tolist()
        stops = ends[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                prints = np.array([simhash(x, shingle) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def identified(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp) for every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                prints = np.array([simhash(x, shingle) for x in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


class VantageTree:
    """A vantage-point tree over one bit range of the fingerprints."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int):
        self.mask = np.uint64(mask)
        self.nodes: list[tuple[np.uint64, int, int, int] | None] = []
        self.leaves = 0
        self._grow(np.unique(sample & self.mask), depth, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, depth: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        split = self._split(points, rng) if depth > 0 and len(points) > 3 else None
        if split is None:
            self.nodes[at] = (np.uint64(0), -1, self.leaves, -1)
            self.leaves += 1
        else:
            point, cutoff, near = split
            left = self._grow(points[near], depth - 1, rng)
            right = self._grow(points[~near], depth - 1, rng)
            self.nodes[at] = (point, cutoff, left, right)
        return at

    @staticmethod
    def _split(points, rng):
        best = None
        for point in rng.choice(points, min(4, len(points)), replace=False):
            d = np.bitwise_count(points ^ point)
            middle = int(np.median(d))
            for cutoff in (middle - 1, middle):
                near = d <= cutoff
                uneven = abs(2 * int(near.sum()) - len(points))
                if 0 < near.sum() < len(points) and (best is None or uneven < best[0]):
                    best = (uneven, point, cutoff, near)
        return best and best[1:]

    def route(self, prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for the home leaf of each row and the leaves it visits.

        A pair that a node separates is found once: the row of the near side
        visits the far side, not the other way round.
        """
        out = []
        stack = [(0, np.arange(len(prints)), np.ones(len(prints), bool))]
        own = prints & self.mask
        while stack:
            at, rows, home = stack.pop()
            if not len(rows):
                continue
            point, cutoff, left, right = self.nodes[at]
            if cutoff < 0:
                out.append((rows, np.full(len(rows), left), home))
                continue
            d = np.bitwise_count(own[rows] ^ point).astype(np.int64)
            near = np.where(home, d <= cutoff, d - reach <= cutoff)
            far = d + reach > cutoff
            stack.append((left, rows[near], home[near]))
            stack.append((right, rows[far], home[far] & (d[far] > cutoff)))
        if not out:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        return tuple(np.concatenate(x) for x in zip(*out))


def band_masks(bands: int) -> list[int]:
    edges = [round(64 * b / bands) for b in range(bands + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def local_groups(left: np.ndarray, right: np.ndarray, right_ids: np.ndarray, left_ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, id within ``radius`` of it) that connect all rows linked between two blocks of fingerprints.

    Rows without a link are set aside first; the rest are grown group by group,
    each row joining once, so a dense group costs no list of pairs.
    """
    touched_left = np.zeros(len(left), bool)
    touched_right = np.zeros(len(right), bool)
    for at in range(0, len(left), 256):
        close = np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius
        close &= left_ids[at : at + 256, None] != right_ids[None, :]
        touched_left[at : at + 256] = close.any(1)
        touched_right |= close.any(0)
    ids, first = np.unique(np.concatenate([left_ids[touched_left], right_ids[touched_right]]), return_index=True)
    prints = np.concatenate([left[touched_left], right[touched_right]])[first]
    members, parents = [], []
    open_rows = np.arange(len(ids))
    while len(open_rows):
        frontier, open_rows = open_rows[:1], open_rows[1:]
        while len(frontier) and len(open_rows):
            parent = np.full(len(open_rows), -1)
            for at in range(0, len(frontier), 256):
                rest = np.flatnonzero(parent < 0)
                if not len(rest):
                    break
                own = frontier[at : at + 256]
                near = np.bitwise_count(prints[own, None] ^ prints[open_rows[rest]][None, :]) <= radius
                hit = near.any(0)
                parent[rest[hit]] = own[near[:, hit].argmax(0)]
            frontier = open_rows[parent >= 0]
            members.append(ids[frontier])
            parents.append(ids[parent[parent >= 0]])
            open_rows = open_rows[parent < 0]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(members), np.concatenate(parents)) if members else (empty, empty)


def shard_links(ids: np.ndarray, prints: np.ndarray, side: np.ndarray, radius: int, mask: int, reach: int, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one shard.  A shard of many rows is parted again by a tree fitted on its own rows."""
    home, all_rows = (side & 1) > 0, (side & 2) > 0
    depth = math.ceil(math.log2(max(1, len(ids)) / leaf_rows)) if len(ids) > 4 * leaf_rows else 0
    if depth:
        tree = VantageTree(prints[:: max(1, len(ids) >> (depth + 3))], mask, depth, 17)
        rows, leaf, first = tree.route(prints, reach)
        if tree.leaves > 1:
            order = np.argsort(leaf, kind="stable")
            rows, leaf, first = rows[order], leaf[order], first[order]
            out = []
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(leaf)) + 1):
                own, at_home = rows[part], first[part]
                # A pair that a node separates meets where one of the two is at home.
                for a, b in ((at_home & home[own], all_rows[own]), (all_rows[own] & at_home, home[own] & ~at_home)):
                    out.append(local_groups(prints[own[a]], prints[own[b]], ids[own[b]], ids[own[a]], radius))
            return tuple(np.concatenate(x) for x in zip(*out))
    return local_groups(prints[home], prints[all_rows], ids[all_rows], ids[home], radius)


def links(classes: DataFrame, radius: int = 3, bands: int = 2, leaf_rows: int = 1024, block_rows: int = 1 << 18, sample_size: int = 16384) -> DataFrame:
    """Links (node, root), each between fingerprints within ``radius`` bits, that connect all classes that such links connect.

    ``classes`` has one row (rep, fp) for each distinct fingerprint.  The trees
    over all rows have as many leaves as the sample can part; a shard of more
    than a few ``leaf_rows`` is parted again by a tree of its own, so its
    comparisons don't grow with the square of the table.
    """
    n = classes.count()
    if n < 2:
        return classes.select(F.col("rep").alias("node"), F.col("rep").alias("root")).limit(0)
    share = min(0.25, sample_size / n)
    sample = np.array([r.fp for r in classes.select("fp").sample(share, seed=7).collect()], np.int64).view(np.uint64)
    depth = max(0, math.ceil(math.log2(n / leaf_rows)))
    trees = [VantageTree(sample, mask, depth, seed) for seed, mask in enumerate(band_masks(bands))]
    reach = radius // bands

    def routed(batch):
        rep = batch.column(0).to_numpy()
        prints = batch.column(1).to_numpy().view(np.uint64)
        base = 0
        for tree in trees:
            rows, leaf, home = tree.route(prints, reach)
            yield rep[rows], prints[rows], leaf + base, home
            base += tree.leaves

    def counted(batches):
        for batch in batches:
            for _, _, leaf, home in routed(batch):
                key, count = np.unique(leaf * 2 + home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // 2), pa.array((key % 2).astype(bool)), pa.array(count)], ["leaf", "home", "n"])

    pairs = classes.select("rep", "fp")
    sizes: dict[int, list[int]] = {}
    for leaf, home, rows in pairs.mapInArrow(counted, "leaf long, home boolean, n long").groupBy("leaf", "home").agg(F.sum("n")).collect():
        sizes.setdefault(leaf, [0, 0])[bool(home)] = rows
    # Blocks of a shard: (home blocks, blocks of all its rows); one each unless it is large.
    split = {leaf: (math.ceil(h / block_rows), math.ceil((h + v) / block_rows)) for leaf, (v, h) in sizes.items() if h + v > block_rows}

    def dealt(batches):
        for batch in batches:
            for rep, prints, leaf, home in routed(batch):
                large = np.isin(leaf, np.fromiter(split, np.int64, len(split)))
                cells = [(rep[~large], prints[~large], leaf[~large], np.zeros((~large).sum(), np.int64), np.where(home[~large], 3, 2))]
                for key in np.unique(leaf[large]).tolist():
                    mine = leaf == key
                    ids, own, at_home = rep[mine], prints[mine], home[mine]
                    rows_a, rows_b = split[key]
                    with np.errstate(over="ignore"):
                        mixed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    block_a, block_b = (mixed % np.uint64(max(rows_a, 1))).astype(np.int64), (mixed % np.uint64(rows_b)).astype(np.int64)
                    for j in range(rows_b):
                        cells.append((ids[at_home], own[at_home], np.full(at_home.sum(), key), block_a[at_home] * rows_b + j, np.ones(at_home.sum(), np.int64)))
                    for i in range(rows_a):
                        cells.append((ids, own, np.full(len(ids), key), i * rows_b + block_b, np.full(len(ids), 2)))
                for ids, own, key, cell, side in cells:
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own.view(np.int64)), pa.array(key.astype(np.int64)), pa.array(cell.astype(np.int64)), pa.array(side.astype(np.int32))], ["rep", "fp", "leaf", "cell", "side"])

    masks, ends = band_masks(bands), np.cumsum([tree.leaves for tree in trees])

    def compared(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        prints = table.column("fp").to_numpy().view(np.uint64)
        mask = masks[int(np.searchsorted(ends, table.column("leaf")[0].as_py(), side="right"))]
        node, root = shard_links(ids, prints, table.column("side").to_numpy(), radius, mask, reach, leaf_rows)
        return pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})

    dealt_rows = pairs.mapInArrow(dealt, "rep long, fp long, leaf long, cell long, side int")
    return dealt_rows.groupBy("leaf", "cell").applyInArrow(compared, "node long, root long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, **tree_options) -> DataFrame:
    """One row (doc_id, fp, fingerprint, component_id) for each row of ``docs``.

    Null or blank texts have fingerprint zero and link like any other.  A null
    doc_id never represents a group; such a row takes the component of the
    documents that share its fingerprint, or null where there are none.
    Repeated rows stay repeated.  Extra columns are not read.
    """
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    roots = components(links(classes, radius, **tree_options))
    by_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = prints.join(by_class, "fp", "left")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_classes(docs: DataFrame, similarity: float, shingle: int, radius: int = 3, stars: int = 1, **tree_options) -> tuple[DataFrame, DataFrame]:
    """Classes (digest, first) of equal shingle sets, and (node, root) of the digests that links connect.

    Classes link at a Jaccard similarity of ``similarity`` or more of their word
    shingles.  Pairs within ``radius`` bits of their SimHash fingerprints meet
    in the shards of vantage-point trees; as that similarity lies about ten bits
    apart, where no tree prunes, the pairs beyond meet by the rarest of their
    shingles.  Every candidate is compared exactly, and only classes that are
    not connected yet are candidates, so large groups of near copies cost no
    list of their pairs.  ``first`` is the least (doc_id, text_hash) of a class.
    """
    classes = cut(shingle_join.classes(docs, similarity, shingle))
    prints = cut(classes.groupBy("fp").agg(F.min("digest").alias("rep")))
    same_print = classes.join(prints, "fp").where("digest <> rep").select(F.col("digest").alias("node"), F.col("rep").alias("root"))
    near = links(prints, radius, **tree_options).unionAll(same_print)
    known = shingle_join.verified(docs, classes, near, similarity, shingle)
    shared = shingle_join.shared_entries(classes)
    for turn in range(stars + 1):
        entries = shingle_join.open_entries(shared, components(known))
        more = shingle_join.stars(entries, similarity, turn) if turn < stars else shingle_join.pairs(entries, similarity)
        known = known.unionAll(shingle_join.verified(docs, classes, more, similarity, shingle))
        discard(entries)
    discard(shared)
    named = cut(classes.select("digest", "first"))
    roots = components(known)
    discard(classes, prints)
    return named, roots


def keep_one(docs: DataFrame, similarity: float | None = None, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, same columns.

    Groups are those of the fingerprints (see ``near_duplicates``), or with
    ``similarity`` those of a Jaccard similarity of word shingles (see
    ``similar_classes``).  The smallest doc_id of a group stays, of rows that
    repeat it the one whose text has the least hash, once; unlike texts under
    one id are judged apart.  Blank texts are copies of each other.  Rows with a
    null doc_id can't stand for a group and stay as they are.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    first = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"))
    if similarity is None:
        shingle, radius = options.pop("shingle", 3), options.pop("radius", 3)
        rows = identified(docs.where("doc_id is not null"), shingle)
        # Fingerprints are the nodes, as unlike texts may share an id.
        classes = cut(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")))
        roots = components(links(classes.select(F.col("fp").alias("rep"), "fp"), radius, **options)).toDF("fp", "root")
        grouped = classes.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    else:
        named, roots = similar_classes(docs.where("doc_id is not null").select("doc_id", "text"), similarity, **options)
        grouped = named.join(roots, named["digest"] == roots["node"], "left").select(F.coalesce("root", "digest").alias("root"), "first")
    chosen = grouped.groupBy("root").agg(F.min("first").alias("first"))
    kept_id, kept_hash, own = unused(docs, "kept_id", "kept_hash", "own_hash")
    wanted = cut(chosen.select(F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash)).distinct())
    marked = docs.where("doc_id is not null").withColumn(own, first["text_hash"])
    same = (F.col("doc_id").cast("long") == F.col(kept_id)) & (F.col(own) == F.col(kept_hash))
    named = marked.join(wanted, same, "left_semi").dropDuplicates(["doc_id", own])
    return named.select(*docs.columns).unionAll(docs.where("doc_id is null").select(*docs.columns))


def op1_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
