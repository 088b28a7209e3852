"""Pair scores and monotonic global alignment of a branch to BASE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary import config
from tributary.functions import similarity as S
from tributary.functions import text as T

KEY = ["merge_id", "branch"]


def pair_matrix(base: DataFrame, branch: DataFrame) -> DataFrame:
    """Similarity components of every BASE shot with every branch shot of the same merge.

    ``base`` and ``branch`` are fingerprint rows; the pairs are bound by the
    shots of one merge, never across merges.
    """
    columns = ["start", "end", "duration", "hash", "rgb", "hist", "bag"]
    b = base.select("merge_id", "base_index", *[F.col(c).alias(f"b_{c}") for c in columns])
    r = branch.select("merge_id", "branch", "branch_index", *[F.col(c).alias(f"r_{c}") for c in columns])
    pairs = b.join(r, "merge_id")
    pairs = (
        pairs.withColumn("structure", S.structure(F.col("b_hash"), F.col("r_hash")))
        .withColumn("rgb", S.mean_rgb(F.col("b_rgb"), F.col("r_rgb")))
        .withColumn("hist", S.histogram(F.col("b_hist"), F.col("r_hist")))
        .withColumn("transcript", T.bag_jaccard(F.col("b_bag"), F.col("r_bag")))
        .withColumn("dur", S.duration(F.col("b_duration"), F.col("r_duration")))
        .withColumn("rel_gap", S.relative_gap(F.col("b_duration"), F.col("r_duration")))
        .withColumn("order_prior", S.order_prior(F.col("base_index"), F.col("branch_index")))
    )
    pairs = pairs.withColumn("visual", S.visual(F.col("structure"), F.col("rgb"), F.col("hist")))
    return pairs.withColumn("score", S.blend(F.col("visual"), F.col("transcript"), F.col("dur"), F.col("order_prior")))


def align_scores(scores: np.ndarray, skip: float = config.SKIP_PENALTY) -> list[tuple[int, int]]:
    """Steps (base, branch) of the best monotonic alignment; -1 stands for a missing side.

    A match adds its score, a skip on either side the penalty.  On ties a match
    beats a delete and a delete beats an insert.
    """
    n, m = scores.shape
    best = np.zeros((n + 1, m + 1))
    move = np.zeros((n + 1, m + 1), np.int8)
    for i in range(1, n + 1):
        best[i, 0], move[i, 0] = best[i - 1, 0] + skip, 1
    for j in range(1, m + 1):
        best[0, j], move[0, j] = best[0, j - 1] + skip, 2
    for i in range(1, n + 1):
        above, row, gains = best[i - 1], best[i], scores[i - 1]
        for j in range(1, m + 1):
            value, way = above[j - 1] + gains[j - 1], 0
            if above[j] + skip > value:
                value, way = above[j] + skip, 1
            if row[j - 1] + skip > value:
                value, way = row[j - 1] + skip, 2
            row[j], move[i, j] = value, way
    steps, i, j = [], n, m
    while i or j:
        way = move[i, j]
        if way == 0:
            i, j = i - 1, j - 1
            steps.append((i, j))
        elif way == 1:
            i -= 1
            steps.append((i, -1))
        else:
            j -= 1
            steps.append((-1, j))
    return steps[::-1]


#: Score rows that are scanned together; what is kept of them is two bits a cell.
BLOCK = 512
#: Below this many cells the plain loop is faster than whole diagonals.
SMALL = 1024


class Aligner:
    """The alignment of one long branch from its score rows, fed in order a block at a time.

    A cell depends on the two diagonals before its own, so a block is computed
    one diagonal at a time, every cell with the sums and comparisons of
    ``align_scores`` in their order: ties fall alike, to the last bit.  Kept are
    the last row and each cell's move in two bits, a thirty-second of the
    scores' size.
    """

    def __init__(self, m: int, skip: float = config.SKIP_PENALTY):
        self.m, self.skip, self.edge = m, skip, 0.0
        self.above = np.concatenate([[0.0], np.cumsum(np.full(m, skip))])
        self.moves: list[np.ndarray] = []
        self.n = 0

    def feed(self, scores: np.ndarray) -> None:
        """The next rows of the matrix, ``BLOCK`` of them but for the last."""
        k, m, skip = len(scores), self.m, self.skip
        self.n += k
        left = np.cumsum(np.concatenate([[self.edge], np.full(k, skip)]))[1:]
        self.edge = left[-1]
        way = np.zeros((k, m), np.int8)
        if m:
            gains, ways = np.ascontiguousarray(scores).ravel(), way.ravel()
            two, one, now = (np.zeros(k + 1) for _ in range(3))
            below = np.zeros(m + 1)
            below[0] = left[-1]
            two[0] = self.above[0]
            one[0], one[1] = self.above[1], left[0]
            for d in range(2, k + m + 1):
                lo, hi = max(1, d - m), min(k, d - 1)
                first, step, count = (lo - 1) * m + d - lo - 1, max(1, m - 1), hi - lo + 1
                cells = slice(first, first + (count - 1) * step + 1, step)
                value = two[lo - 1 : hi] + gains[cells]
                up, back = one[lo - 1 : hi] + skip, one[lo : hi + 1] + skip
                deletes = up > value
                value = np.where(deletes, up, value)
                inserts = back > value
                now[lo : hi + 1] = np.where(inserts, back, value)
                ways[cells] = np.where(inserts, 2, deletes)
                if d <= m:
                    now[0] = self.above[d]
                if d <= k:
                    now[d] = left[d - 1]
                if hi == k:
                    below[d - k] = now[k]
                two, one, now = one, now, two
            self.above = below
        packed = np.zeros((k, -(-m // 4)), np.uint8)
        for lane in range(4):
            part = way[:, lane::4]
            packed[:, : part.shape[1]] |= part.astype(np.uint8) << (2 * lane)
        self.moves.append(packed)

    def steps(self) -> list[tuple[int, int]]:
        out, i, j = [], self.n, self.m
        while i or j:
            way = 2 if not i else 1 if not j else self.moves[(i - 1) // BLOCK][(i - 1) % BLOCK, (j - 1) // 4] >> (2 * ((j - 1) % 4)) & 3
            i, j = i - (way != 2), j - (way != 1)
            out.append((-1 if way == 2 else i, -1 if way == 1 else j))
        return out[::-1]


class _Streamed:
    """Steps of one merge and branch whose score rows arrive one by one."""

    def __init__(self, m: int):
        self.m, self.held, self.aligner = m, [], None

    def add(self, row: np.ndarray) -> None:
        self.held.append(row)
        if len(self.held) == BLOCK:
            self._flush()

    def _flush(self) -> None:
        self.aligner = self.aligner or Aligner(self.m)
        self.aligner.feed(np.array(self.held).reshape(len(self.held), self.m))
        self.held = []

    def steps(self) -> list[tuple[int, int]]:
        if self.aligner is None and len(self.held) * self.m <= SMALL:
            return align_scores(np.array(self.held).reshape(len(self.held), self.m))
        if self.held:
            self._flush()
        return self.aligner.steps()


def score_rows(base: DataFrame, pairs: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """(merge_id, branch, base_index, scores): each BASE shot's scores in branch order, empty where the branch has no shots."""
    every = base.select("merge_id", F.explode(F.array(*map(F.lit, branches))).alias("branch"), "base_index", F.lit(None).cast("struct<branch_index:long,score:double>").alias("c"))
    cells = pairs.select(*KEY, "base_index", F.struct(F.col("branch_index").cast("long").alias("branch_index"), "score").alias("c")).unionAll(every)
    grouped = cells.groupBy(*KEY, "base_index").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return grouped.select(*KEY, "base_index", F.transform("c", lambda c: c["score"]).alias("scores"))


def alignment_steps(base: DataFrame, branch: DataFrame, pairs: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """(merge_id, branch, step, base_index, branch_index) in order; null for a missing side.

    The rows of each score matrix stream in order through a task that keeps two
    bits of each cell, so a merge of 7,000 shots a side holds 12 MB and no row
    of the data holds more than one shot's scores.  A branch without shots
    deletes all of BASE; a BASE without shots makes all shots inserts.
    """
    rows = score_rows(base, pairs, branches).repartition(*KEY).sortWithinPartitions(*KEY, "base_index")

    def run(batches):
        key, group, out = None, None, [[] for _ in range(5)]

        def close():
            steps = group.steps()
            out[0].extend([key[0]] * len(steps))
            out[1].extend([key[1]] * len(steps))
            out[2].extend(range(len(steps)))
            out[3].extend(s[0] if s[0] >= 0 else None for s in steps)
            out[4].extend(s[1] if s[1] >= 0 else None for s in steps)

        def ready():
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], [*KEY, "step", "base_index", "branch_index"])
            for o in out:
                o.clear()
            return batch

        for batch in batches:
            merges, names, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            bounds, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for r in range(batch.num_rows):
                if group is None or (merges[r], names[r]) != key:
                    if group is not None:
                        close()
                        if len(out[0]) >= 50_000:
                            yield ready()
                    key, group = (merges[r], names[r]), _Streamed(bounds[r + 1] - bounds[r])
                # Copied: a held row must not keep its whole batch.
                group.add(values[bounds[r] : bounds[r + 1]].copy())
        if group is not None:
            close()
        yield ready()

    aligned = rows.mapInArrow(run, "merge_id long, branch string, step long, base_index long, branch_index long")
    alone = branch.join(base.select("merge_id").distinct(), "merge_id", "left_anti")
    index = F.col("branch_index").cast("long")
    return aligned.unionAll(alone.select(F.col("merge_id").cast("long"), "branch", index.alias("step"), F.lit(None).cast("long").alias("base_index"), index.alias("branch_index")))


def infer_operation(base_index, branch_index, visual, transcript, rel_gap, b_speech, r_speech):
    """Edit operation of a step from its components (null where not comparable)."""

    def says(threshold: float):
        return F.when(~b_speech & ~r_speech, F.lit(True)).otherwise(F.coalesce(transcript >= threshold, F.lit(False)))

    seen = lambda limit: F.coalesce(visual >= limit, F.lit(False))
    return (
        F.when(base_index.isNull(), "insert")
        .when(branch_index.isNull(), "delete")
        .when((rel_gap <= config.UNCHANGED_MAX_REL_DIFF) & seen(config.UNCHANGED_MIN) & says(config.UNCHANGED_MIN), "unchanged")
        .when((rel_gap > 0) & (rel_gap < config.TRIM_MAX_REL_DIFF) & seen(config.TRIM_MIN_VISUAL) & says(config.REPLACE_MIN), "trim")
        .when(seen(config.REPLACE_MIN) & (F.coalesce(transcript < config.REPLACE_MIN, F.lit(False)) | (visual < config.UNCHANGED_MIN)), "replace")
        .otherwise("uncertain")
    )


def matches(base: DataFrame, branch: DataFrame, pairs: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """Alignment steps with scores, operation, confidence and both shots' text and times."""
    steps = alignment_steps(base, branch, pairs, branches)
    scored = pairs.select(*KEY, "base_index", "branch_index", "visual", "transcript", "dur", "order_prior", "rel_gap", "score")
    b = base.select("merge_id", "base_index", F.col("text").alias("base_text"), F.col("start").alias("base_start"), F.col("end").alias("base_end"), F.col("has_speech").alias("b_speech"))
    r = branch.select(*KEY, "branch_index", F.col("normalized").alias("branch_text"), F.col("text").alias("branch_raw"), F.col("start").alias("branch_start"), F.col("end").alias("branch_end"), F.col("has_speech").alias("r_speech"))
    rows = steps.join(b, ["merge_id", "base_index"], "left").join(r, [*KEY, "branch_index"], "left").join(scored, [*KEY, "base_index", "branch_index"], "left")
    rows = rows.withColumn("operation", infer_operation(*[F.col(c) for c in ("base_index", "branch_index", "visual", "transcript", "rel_gap", "b_speech", "r_speech")]))
    alone = F.col("operation").isin("insert", "delete")
    rows = rows.withColumn("final_score", F.when(alone, F.lit(1.0)).otherwise(F.col("score"))).withColumn("confidence", F.col("final_score"))
    used = S.used_components(F.col("visual"), F.col("transcript"), F.col("dur"), F.col("order_prior"))
    return rows.withColumn("used", F.when(alone, "").otherwise(used))


def neighbours(rows: DataFrame) -> DataFrame:
    """Previous and next operation of every step, ``start`` and ``end`` at the borders."""
    w = W.partitionBy(*KEY).orderBy("step")
    return rows.withColumn("previous_match", F.lag("operation", 1, "start").over(w)).withColumn("next_match", F.lead("operation", 1, "end").over(w))
