"""Long merges and videos: the same rows as plain loops, spread over parts, in bounded memory."""

import random
import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import align, claims, evaluate, media, merge, ordered


def matrices():
    rng = np.random.default_rng(7)
    for t in range(520):
        n, m = rng.integers(0, 60, 2) if t % 4 else rng.integers(0, 4, 2)
        kind = t % 5
        if kind == 0:
            yield rng.random((n, m))
        elif kind == 1:  # many ties
            yield rng.choice([0.0, 0.1, -0.1, -0.05, 0.3, 0.7, 1.0], (n, m))
        elif kind == 2:
            yield np.full((n, m), rng.choice([-0.1, -0.05, 0.0, 0.3]))
        elif kind == 3:
            yield np.round(rng.random((n, m)), 1)
        else:
            yield -rng.random((n, m)) * 0.2


@pytest.mark.parametrize("block", [1, 7, 512])
def test_diagonals_equal_the_plain_loop(monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    for scores in matrices():
        own = align.Aligner(scores.shape[1])
        for i in range(0, len(scores), block):
            own.feed(scores[i : i + block])
        assert own.steps() == align.align_scores(scores)


def test_seven_thousand_shots_a_side():
    rng = np.random.default_rng(1)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    group = align._Streamed(7000)
    for _ in range(7000):
        group.add(rng.random(7000))
    steps = group.steps()
    assert time.time() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert [s[0] for s in steps if s[0] >= 0] == list(range(7000)) == [s[1] for s in steps if s[1] >= 0]


def test_steps_of_long_short_and_one_sided_merges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sizes = {(1, "branch_a"): (90, 70), (1, "branch_b"): (90, 0), (2, "branch_a"): (3, 4), (2, "branch_b"): (3, 3), (3, "branch_a"): (0, 5)}
    scores = {k: np.round(rng.random(s), 1) for k, s in sizes.items()}
    base = spark.createDataFrame([(g, i) for g, n in ((1, 90), (2, 3)) for i in range(n)], "merge_id long, base_index long")
    branch = spark.createDataFrame([(*k, j) for k, (_, m) in sizes.items() for j in range(m)], "merge_id long, branch string, branch_index long")
    pairs = spark.createDataFrame([(*k, i, j, float(s[i, j])) for k, s in scores.items() for i in range(s.shape[0]) for j in range(s.shape[1])], "merge_id long, branch string, base_index long, branch_index long, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        rows = align.alignment_steps(base, branch, pairs.repartition(5), ("branch_a", "branch_b")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, s in scores.items():
        mine = sorted((r.step, r.base_index, r.branch_index) for r in rows if (r.merge_id, r.branch) == key)
        assert mine == [(k, *(x if x >= 0 else None for x in step)) for k, step in enumerate(align.align_scores(s))]
    assert len(rows) == sum(len(align.align_scores(s)) for s in scores.values())


def test_regions_against_all_cuts(spark):
    rng = random.Random(4)
    places = [None, *range(12)]
    regions = [(rng.choice([1, 1, 1, 2]), f"c{i}", "evidence", rng.choice(places), rng.choice(places)) for i in range(300)]
    gone = [(rng.choice([1, 2]), rng.choice(["branch_a", "branch_b"]), *(rng.choice([None, *range(12)]) for _ in range(2))) for _ in range(9)]
    r = spark.createDataFrame([(g, c, k, None if s is None else float(s), None if e is None else float(e)) for g, c, k, s, e in regions], "merge_id long, claim_id string, kind string, start double, end double")
    c = spark.createDataFrame([(g, b, *(None if x is None else float(x) for x in (s, e))) for g, b, s, e in gone], "merge_id long, branch string, cut_start double, cut_end double")

    def hit(region, branch):
        g, _, _, s, e = region
        return any(g == cg and branch == cb and None not in (s, e, cs, ce) and e > cs and s < ce for cg, cb, cs, ce in gone)

    want = sorted((x[1], b) for x in regions for b in ("branch_a", "branch_b") if not hit(x, b))
    assert sorted((x.claim_id, x.branch) for x in claims.project(r, c).collect()) == want


def test_a_merge_of_many_cuts(spark):
    n = 100_000
    gone = spark.range(n).select(F.lit(1).alias("merge_id"), F.lit("branch_a").alias("branch"), (F.col("id") * 2.0).alias("cut_start"), (F.col("id") * 2.0 + 1).alias("cut_end"))
    asked = spark.range(n).select(F.lit(1).alias("merge_id"), F.col("id").cast("string").alias("claim_id"), F.lit("evidence").alias("kind"), (F.col("id") * 2.0 + 1).alias("start"), (F.col("id") * 2.0 + F.when(F.col("id") % 2 == 0, 2).otherwise(2.5)).alias("end"))
    got = claims.project(asked, gone).groupBy("branch").count().collect()
    assert {r.branch: r["count"] for r in got} == {"branch_a": n // 2 + 1, "branch_b": n}


@pytest.fixture()
def long_video(spark):
    rng = random.Random(8)
    rows = [(v, i, i * 0.5, rng.choice([0.0, 5.0, 40.0, None])) for v, n in ((1, 4000), (2, 3), (3, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "video_id long, frame long, ts double, delta double")


def test_shots_and_keyframes_of_a_long_video(spark, long_video, monkeypatch):
    rows, frames = long_video
    placed, parts = ordered._placed, []
    monkeypatch.setattr(ordered, "_placed", lambda df, order, n: parts.append(1) or placed(df, order, 11))
    shots = media.segment_shots(frames)
    got = sorted((r.video_id, r.sequence_index, r.start, r.end) for r in shots.collect())
    want = []
    for v in (1, 2, 3):
        own = [r for r in rows if r[0] == v]
        starts = [own[0][2]] + [r[2] for r in own[1:] if (r[3] or 0) > 27.0]
        if own[-1][2] > own[0][2]:
            want += [(v, k, s, e) for k, (s, e) in enumerate(zip(starts, [*starts[1:], own[-1][2]]))]
    assert got == sorted(want) and parts
    keys = {(r.video_id, r.sequence_index): r.frame for r in media.keyframes(shots, frames).collect()}
    for v, k, s, e in want:
        seen = [r[1] for r in rows if r[0] == v and r[2] <= (s + e) / 2]
        assert keys.get((v, k)) == (max(seen) if seen and e > s else None)


def test_inserts_of_a_long_merge(spark, monkeypatch):
    placed = ordered._placed
    monkeypatch.setattr(ordered, "_placed", lambda df, order, n: placed(df, order, 9))
    rng = random.Random(2)
    base, at = [], 0.0
    for i in range(800):
        length = rng.choice([0.0, 1.0, 2.5])
        base.append((1, i, at, at + length))
        at += length
    inserts = [(1, "branch_a", -1, k, "t", rng.uniform(-5, at + 5), 0.0) for k in range(200)]
    got = merge.attach_inserts(
        spark.createDataFrame(inserts, "merge_id long, branch string, base_index long, branch_index long, text string, start double, end double"),
        spark.createDataFrame(base, "merge_id long, base_index long, start double, end double"),
    )
    want = {k: max((b[1] for b in base if b[3] <= s), default=0) for _, _, _, k, _, s, _ in inserts}
    assert {r.branch_index: r.anchor for r in got.collect()} == want


def test_attempts_and_counters_of_a_long_log(spark, monkeypatch):
    placed = ordered._placed
    monkeypatch.setattr(ordered, "_placed", lambda df, order, n: placed(df, order, 7))
    rng = random.Random(6)
    log = [(f, i, rng.random() < 0.3, rng.choice(["provider"] * 30 + ["schema"])) for f in ("x", "y", "z") for i in range(300)]
    df = spark.createDataFrame([(f, i, ok, None if ok else c) for f, i, ok, c in log], "fixture string, attempt long, ok boolean, category string")
    want = set()
    for f in ("x", "y", "z"):
        won = lost = stopped = 0
        for _, i, ok, c in (r for r in log if r[0] == f):
            if won < 5 and lost < 9 and not stopped:
                want.add((f, i))
            won, lost, stopped = won + ok, lost + (not ok), stopped + (not ok and c != "provider")
    assert {(r.fixture, r.attempt) for r in evaluate.attempt_window(df, 5, 9).collect()} == want
    snaps = [(f, i, rng.choice([None, i * 2]), i * 3) for f in ("x", None) for i in range(200)]
    got = evaluate.counter_deltas(spark.createDataFrame(snaps, "fixture string, at long, calls long, retries long"), ["fixture"], "at", ["calls", "retries"]).collect()
    by = {(f, i): (c, r) for f, i, c, r in snaps}
    for r in got:
        c, n = by[r.fixture, r.at]
        pc, pn = by.get((r.fixture, r.at - 1), (0, 0))
        assert (r.calls, r.retries) == (None if c is None else c - (pc or 0), n - pn)


def test_overlaps_of_uneven_lengths(spark):
    rng = random.Random(12)
    shots, segments = [], []
    for v in (1, 2):
        for i in range(120):
            s = rng.choice([rng.uniform(-50, 50), float(rng.randint(-8, 8))])
            shots.append((v, i, s, s + rng.choice([0.0, 0.001, 0.25, 1.0, 2.0, 4.0, rng.paretovariate(0.6)])))
        for k in range(250):
            s = rng.choice([rng.uniform(-60, 60), float(rng.randint(-8, 8))])
            segments.append((v, k, s, s + rng.choice([0.0, 0.5, 1.0, 1e-5, rng.paretovariate(0.5), 3600.0]), "t"))
    got = media.attach_segments(
        spark.createDataFrame(segments, "video_id long, seg_no long, start double, end double, text string"), spark.createDataFrame(shots, "video_id long, sequence_index long, start double, end double")
    )
    want = set()
    for v, k, s, e, _ in segments:
        near = [(min(e, he) - max(s, hs), i) for w, i, hs, he in shots if w == v and he > hs and e > s and min(e, he) > max(s, hs)]
        want |= {(v, k, i) for n, i in near if n == max(near)[0]}
    rows = [(r.video_id, r.seg_no, r.sequence_index) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_one_long_shot_beside_many_short_ones(spark):
    n = 20_000
    shots = spark.range(n).select(F.lit(1).alias("video_id"), F.col("id").alias("sequence_index"), (F.col("id") * 0.01).alias("start"), (F.col("id") * 0.01 + 0.01).alias("end"))
    shots = shots.unionAll(spark.sql(f"SELECT 1, {n}L, 0D, 3600D"))
    said = spark.range(n).select(F.lit(1).alias("video_id"), F.col("id").alias("seg_no"), (F.col("id") * 0.01 + 0.002).alias("start"), (F.col("id") * 0.01 + 0.006).alias("end"), F.lit("t").alias("text"))
    left = media._on_levels(media._levelled(said, "start", "end"), "start", "end", media._levelled(shots, "start", "end").select("level").distinct(), False)
    # A row stands in at most two nodes at each of the few levels in use.
    assert left.count() <= n * 2 * 4
    got = media.attach_segments(said, shots).groupBy().agg(F.count("*").alias("n"), F.countDistinct("seg_no").alias("d")).first()
    assert (got.n, got.d) == (2 * n, n)
