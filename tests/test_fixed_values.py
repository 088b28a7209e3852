"""Results that fixed values decide: frame hash, retries, failure classes; and the as-of join against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import evaluate, media, render


def plain_hash(pixels, mean):
    n = 32
    basis = [[math.cos(math.pi * (i + 0.5) * k / n) * math.sqrt(2 / n) * (1 / math.sqrt(2) if i == 0 else 1) for k in range(n)] for i in range(n)]
    half = [[sum(basis[u][i] * pixels[i * n + j] for i in range(n)) for j in range(n)] for u in range(8)]
    low = [sum(half[u][j] * basis[v][j] for j in range(n)) for u in range(8) for v in range(8)]
    low[0] = 0.0
    ordered = sorted(low)
    middle = (ordered[31] + ordered[32]) / 2
    bits = "".join(format(int(c) >> 5, "03b") for c in mean) + "".join("1" if x > middle else "0" for x in low[:55])
    return f"{int(bits, 2):016x}"


def test_all_bits_of_the_frame_hash(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(256)) for _ in range(1024)], [float(rng.randrange(256)) for _ in range(3)]) for i in range(4)]
    rows.append((9, [float((x % 32) * 4 + x // 32) for x in range(1024)], [10.0, 200.0, 90.0]))
    got = {r.id: r.h for r in spark.createDataFrame(rows, "id long, p array<double>, m array<double>").select("id", media.perceptual_hash(F.col("p"), F.col("m")).alias("h")).collect()}
    assert got == {i: plain_hash(p, m) for i, p, m in rows}


@pytest.mark.parametrize(
    "status, body, error, want",
    [
        (429, "", None, True), (502, None, None, True), (401, "upstream_503: try later", None, True), (401, "Upstream 503", None, True), (500, "Rate limit exceeded", None, True),
        (400, "connection_reset by peer", None, True), (401, "overloaded, but invalid_api_key", None, False), (400, "temporary unavailable; code 401", None, False),
        (500, "boom", None, False), (200, "", None, False), (None, "", "ConnectError", True), (None, "overload", "ValueError", False), (403, "forbidden: overload", None, True),
    ],
)
def test_retries(spark, status, body, error, want):
    row = spark.createDataFrame([(status, body, error)], "s int, b string, e string")
    assert row.select(evaluate.retryable(F.col("s"), F.col("b"), F.col("e")).alias("x")).first().x is want


def test_retry_after(spark):
    rows = [("7", 7.0), (" 2.5 ", 2.5), ("0", None), ("-3", None), ("soon", None), ("", None), (None, None), ("Wed, 01 Jan 2025 00:00:30 GMT", 30.0), ("Tue, 31 Dec 2024 23:59:59 GMT", None)]
    df = spark.createDataFrame([r[:1] for r in rows], "h string").select(evaluate.retry_after_seconds(F.col("h"), F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("x"))
    assert [r.x for r in df.collect()] == [x for _, x in rows]


@pytest.mark.parametrize(
    "message, error, want",
    [
        ("GMI Cloud 503: x", "RuntimeError", "provider"), ("some cloud 503", "RuntimeError", "orchestrator"), ("Overloaded", "ValueError", "provider"),
        ("M3 failed to return a valid claim list", "RuntimeError", "schema"), ("failed to return a valid thing", "Odd", "unknown"), ("body was NON-json", "Odd", "schema"),
        ("no rule matched", "KeyError", "semantic"), ("x", "JSONDecodeError", "schema"), (None, "AssertionError", "orchestrator"), (None, None, "unknown"),
    ],
)
def test_failure_classes(spark, message, error, want):
    row = spark.createDataFrame([(message, error)], "m string, e string")
    assert row.select(evaluate.classify_failure(F.col("m"), F.col("e")).alias("x")).first().x == want


def test_keyframes_against_all_pairs(spark):
    rng = random.Random(1)
    frames = [(v, i, float(rng.randrange(40)) / 2) for v in (1, 2) for i in range(60)]
    shots = [(v, k, float(rng.randrange(20)), float(rng.randrange(20))) for v in (1, 2, 3) for k in range(15)]
    got = media.keyframes(spark.createDataFrame(shots, "video_id long, sequence_index long, start double, end double"), spark.createDataFrame(frames, "video_id long, frame long, ts double"))
    want = set()
    for v, k, a, b in shots:
        near = [(ts, i) for w, i, ts in frames if w == v and ts <= (a + b) / 2]
        if b > a and near:
            want.add((v, k, (a + b) / 2, max(near)[1]))
    assert {tuple(r) for r in got.collect()} == want


def test_shots_without_segments_keep_their_row(spark):
    local = spark.createDataFrame([(1, 0, 5, 1.0, 2.0, "a")], "video_id long, sequence_index long, seg_no long, start double, end double, text string")
    shots = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 1, 20.0, 30.0)], "video_id long, sequence_index long, start double, end double")
    rows = {r.sequence_index: r for r in render.to_video_time(local, shots).collect()}
    assert rows[0].start == 11.0 and rows[0].end == 12.0 and (1 not in rows or rows[1].seg_no is None)
