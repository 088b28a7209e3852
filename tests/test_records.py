"""Record validation, caches, as-of and overlap joins on small inputs, against plain loops where there is a rule to repeat."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import claims, gate, media, merge, validate
from tributary.sources import files

CLAIM = {"claim_id": "C1", "meaning": "m", "claim_type": "qualifier", "importance": "high"}
SPAN = {"start": 1.0, "end": 1.0, "description": "d"}


def judge(spark, check, records):
    rows = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i int, raw string")
    return [r.p for r in rows.select("i", check(F.col("raw")).alias("p")).orderBy("i").collect()]


def test_claim_records(spark):
    got = judge(
        spark, validate.claim_problem,
        [CLAIM, {**CLAIM, "evidence_regions": [SPAN]}, {**CLAIM, "x": 1}, {k: v for k, v in CLAIM.items() if k != "meaning"}, {**CLAIM, "meaning": ""}, {**CLAIM, "claim_type": "fact"}, {**CLAIM, "importance": "urgent"},
         {**CLAIM, "evidence_regions": [{**SPAN, "end": 0.5}]}, {**CLAIM, "equivalents": [SPAN, {**SPAN, "start": -1}]}, {**CLAIM, "equivalents": [{**SPAN, "y": 1}]}, {**CLAIM, "equivalents": [None]}, "{", "[]"],
    )
    assert got == [None, None, "unknown key", "missing key", "blank meaning", "claim type", "importance", "evidence", "equivalents", "equivalents", "equivalents", "malformed", "malformed"]


def test_analysis_records(spark):
    raw = spark.range(1).select(validate.expected_payload(*map(F.lit, ("preserved", "broken", "broken", "creates_new_conflict"))).alias("p")).first().p
    good = json.loads(raw)
    bad_span = json.loads(raw)
    bad_span["branch_b_impact"]["evidence"][0]["video"] = "elsewhere"
    bad_pair = json.loads(raw)
    bad_pair["interactions"].append({**good["interactions"][0], "confidence": 1.01})
    without = {k: v for k, v in good.items() if k != "interactions"}
    got = judge(spark, validate.analysis_problem, [good, {**good, "overall_confidence": -0.1}, {**good, "interactions": []}, without, bad_span, bad_pair, {**good, "combined_impact": "gone"}])
    assert got == [None, "overall confidence", "no interaction", None, "branch_b: evidence", "interaction", "combined impact"]


def test_transcript_cache_is_all_or_nothing(spark, tmp_path):
    rows = [("a", 0.0, 1.0, "x", 0.5), ("a", 1.0, 2.0, "", None), ("b", 0.0, 1.0, "x", 1.5), ("b", 1.0, 2.0, "y", 0.5), ("c", -1.0, 1.0, "x", None), ("d", 0.0, 1.0, None, None)]
    files.write_transcripts(spark.createDataFrame(rows, "fingerprint string, start double, end double, text string, confidence double"), str(tmp_path / "t"))
    got = {r.fingerprint: r.segments for r in files.read_transcripts(spark, str(tmp_path / "t")).collect()}
    assert [s.text for s in got["a"]] == ["x", ""] and got["b"] is got["c"] is got["d"] is None


def test_segments_meet_the_shots_they_overlap_most(spark):
    rng = random.Random(3)
    shots, segments = [], []
    for v in range(4):
        at = rng.uniform(-5, 5)
        for i in range(rng.randint(1, 12)):
            length = rng.choice([0.0, 0.5, 1.0, 20.0, 300.0])
            shots.append((v, i, at, at + length))
            at += length
        segments += [(v, k, s := rng.uniform(-20, at + 20), s + rng.choice([0.0, 0.25, 3.0, 1000.0]), f"w{k}") for k in range(40)]
    want = set()
    for v, k, s, e, _ in segments:
        over = {i: min(e, b) - max(s, a) for w, i, a, b in shots if w == v}
        most = max(over.values())
        want |= {(v, k, i) for i, x in over.items() if x == most and x > 0}
    got = media.attach_segments(
        spark.createDataFrame(segments, "video_id int, seg_no int, start double, end double, text string"), spark.createDataFrame(shots, "video_id int, sequence_index int, start double, end double")
    ).select("video_id", "seg_no", "sequence_index").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_inserts_take_the_last_shot_of_the_unbroken_run(spark):
    rng = random.Random(5)
    base = [(m, i, rng.choice([1.0, 2.0, 3.0, 4.0])) for m in range(5) for i in range(6)]
    inserts = [(m, "branch_a", k, rng.choice([0.0, 1.0, 2.0, 2.5, 9.0])) for m in range(5) for k in range(8)]
    want = {}
    for m, _, k, at in inserts:
        anchor = 0
        for i, end in [(i, e) for n, i, e in base if n == m]:
            if end > at:
                break
            anchor = i
        want[m, k] = anchor
    got = merge.attach_inserts(spark.createDataFrame(inserts, "merge_id int, branch string, branch_index long, start double"), spark.createDataFrame(base, "merge_id int, base_index long, end double")).collect()
    assert {(r.merge_id, r.branch_index): r.anchor for r in got} == want and len(got) == len(inserts)


def test_a_video_without_cuts_is_one_shot(spark):
    frames = spark.createDataFrame([(1, 0, 0.2, 0.0), (1, 1, 1.0, 5.0), (2, 2, 0.0, 0.0), (2, 3, 4.0, 90.0)], "video_id int, frame long, ts double, delta double")
    lengths = spark.createDataFrame([(1, 3.0), (2, 6.0)], "video_id int, duration double")
    words = spark.createDataFrame([(1, 0, 0.5, 1.0, "hello")], "video_id int, seg_no long, start double, end double, text string")
    got = sorted(tuple(r) for r in media.process_video(frames, lengths, words).select("video_id", "shot_id", "start", "end", "keyframe", "transcript").collect())
    assert got == [(1, "shot_0000", 0.0, 3.0, 1, "hello"), (2, "shot_0000", 0.0, 4.0, 2, ""), (2, "shot_0001", 4.0, 6.0, 3, "")]


def test_an_ineligible_fixture_aborts_after_the_report(spark, tmp_path):
    fixtures = spark.createDataFrame([(1, True), (2, False)], "fixture int, eligible boolean")
    reasons = spark.createDataFrame([(2, "branch_a: missing negation markers")], "fixture int, reason string")
    with pytest.raises(ValueError):
        gate.require_eligible(fixtures, reasons, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).where("size(reasons) = 1").count() == 1


def test_statuses_without_a_provider_are_the_surrogates(spark):
    s = spark.createDataFrame([(1, "c", "branch_a", "broken")], "merge_id int, claim_id string, view string, status string")
    r = claims.with_verdicts(s, None).first()
    assert (r.status, r.surrogate, r.confidence) == ("broken", True, 1.0)
