"""Alignment, composition, views, claims, evaluation and media operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import align, claims, evaluate, gate, media, merge, validate
from tributary.sources import files


def plain_alignment(scores, skip=-0.05):
    """Best value over all monotonic alignments, by recursion."""
    from functools import lru_cache

    n, m = scores.shape

    @lru_cache(None)
    def best(i, j):
        if i == 0 and j == 0:
            return 0.0
        options = []
        if i and j:
            options.append(best(i - 1, j - 1) + scores[i - 1, j - 1])
        if i:
            options.append(best(i - 1, j) + skip)
        if j:
            options.append(best(i, j - 1) + skip)
        return max(options)

    return best(n, m)


def test_alignment_is_optimal_and_monotonic():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(0, 7, 2)
        scores = np.round(rng.random((n, m)), 1)
        steps = align.align_scores(scores)
        got = sum(scores[i, j] if i >= 0 and j >= 0 else -0.05 for i, j in steps)
        assert got == pytest.approx(plain_alignment(scores))
        assert [i for i, _ in steps if i >= 0] == list(range(n)) and [j for _, j in steps if j >= 0] == list(range(m))


def test_alignment_ties_and_empty_sides():
    assert align.align_scores(np.zeros((0, 2))) == [(-1, 0), (-1, 1)] and align.align_scores(np.zeros((2, 0))) == [(0, -1), (1, -1)]
    assert align.align_scores(np.array([[-0.1]])) == [(0, 0)]  # a match beats two skips of the same worth
    assert align.align_scores(np.array([[-0.2]])) == [(-1, 0), (0, -1)]


def test_dual_rules_exhaustively(spark):
    kinds = merge.EDIT_KINDS
    base, units = [], []
    for i, (a, b, same) in enumerate((a, b, same) for a in kinds for b in kinds for same in (True, False)):
        base.append((1, i, f"Base {i}", float(i), i + 1.0))
        for branch, kind, text in (("branch_a", a, "t"), ("branch_b", b, "t" if same else "u")):
            units.append((1, branch, i, i, kind, kind, text if kind == "replace" else "", text if kind in ("trim", "unchanged") else "", 0.9))
    base = spark.createDataFrame(base, "merge_id long, base_index long, text string, start double, end double")
    units = spark.createDataFrame(units, "merge_id long, branch string, base_index long, branch_index long, operation string, kind string, replacement_text string, retained_text string, confidence double")
    nothing = spark.createDataFrame([], "merge_id long, anchor long")
    rows = merge.compose(base, units, nothing).collect()
    assert len(rows) == 32
    for r in rows:
        a, b = r.a_kind, r.b_kind
        agree = (r.a_replacement_text, r.a_retained_text) == (r.b_replacement_text, r.b_retained_text)
        if a == b == "unchanged":
            want = ("preserved", r.text)
        elif "unchanged" in (a, b) or a == b == "delete" or (a == b and agree):
            kind = a if a != "unchanged" else b
            text = (r.a_replacement_text or r.a_retained_text) if a != "unchanged" else (r.b_replacement_text or r.b_retained_text)
            want = {"delete": ("deleted", ""), "replace": ("replaced", text), "trim": ("trimmed", text)}[kind]
        else:
            want = ("unresolved", "")
        assert (r.verdict, r.combined_text) == want, (a, b, agree)
    attached = spark.createDataFrame([(1, 0)], "merge_id long, anchor long")
    assert merge.compose(base, units, attached).where("base_index = 0").first().verdict == "unresolved"


def test_insert_anchor(spark):
    base = spark.createDataFrame([(1, i, 2.0 * i, 2.0 * i + 2) for i in range(4)], "merge_id long, base_index long, start double, end double")
    inserts = spark.createDataFrame([(1, "branch_a", i, s) for i, s in enumerate([0.0, 2.0, 5.9, 6.0, 99.0])], "merge_id long, branch string, branch_index long, start double")
    got = {r.branch_index: r.anchor for r in merge.attach_inserts(inserts, base).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_claim_survival(spark):
    regions = spark.createDataFrame([(1, "c", "evidence", 0.0, 2.0), (1, "c", "equivalent", 4.0, 6.0), (1, "d", "evidence", 2.0, 4.0)], "merge_id long, claim_id string, kind string, start double, end double")
    cut = spark.createDataFrame([(1, "branch_a", 0.0, 2.0), (1, "branch_b", 4.0, 6.0)], "merge_id long, branch string, cut_start double, cut_end double")
    judged = spark.createDataFrame([(1, "c", "fact", "high"), (1, "d", "fact", "low")], "merge_id long, claim_id string, claim_type string, importance string")
    alive = claims.project(regions, cut)
    status = {(r.claim_id, r["view"]): r.status for r in claims.surrogate(judged, alive).collect()}
    assert status == {("c", "branch_a"): "preserved", ("c", "branch_b"): "preserved", ("c", "combined"): "broken", ("d", "branch_a"): "preserved", ("d", "branch_b"): "preserved", ("d", "combined"): "preserved"}
    verdicts = claims.with_verdicts(claims.surrogate(judged, alive), spark.createDataFrame([], "merge_id long, claim_id string, view string, status string, confidence double"))
    inter = claims.interactions(verdicts, judged)
    assert {r.claim_id: r.interaction for r in inter.collect()} == {"c": "creates_new_conflict", "d": "none"}
    top = claims.overall(spark.createDataFrame([(1,), (2,)], "merge_id long"), inter, verdicts).orderBy("merge_id").collect()
    assert (top[0].overall_interaction, top[0].overall_impact, top[0].conflict, top[0].evaluation_calls) == ("creates_new_conflict", "broken", True, 6)
    assert (top[1].overall_interaction, top[1].overall_impact, top[1].overall_confidence) == ("none", "preserved", 0.0)


def test_modal_takes_first_seen_on_ties(spark):
    rows = spark.createDataFrame([("f", 0, "b"), ("f", 1, "a"), ("f", 2, "a"), ("f", 3, "b"), ("g", 0, ""), ("g", 1, "z")], "fixture string, run int, v string")
    got = {r.fixture: (r.v, r.variance, r.n_runs) for r in evaluate.modal(rows, ["fixture"], "v", "run").collect()}
    assert got == {"f": ("b", 2, 4), "g": ("z", 1, 1)}


def test_attempt_window(spark):
    log = [("p", i, i % 3 == 2, None if i % 3 == 2 else "provider") for i in range(20)]
    log += [("s", 0, False, "provider"), ("s", 1, False, "schema"), ("s", 2, True, None)] + [("x", i, False, "provider") for i in range(15)]
    got = evaluate.attempt_window(spark.createDataFrame(log, "fixture string, attempt int, ok boolean, category string")).groupBy("fixture").count().collect()
    assert {r.fixture: r["count"] for r in got} == {"p": 12, "s": 2, "x": 12}


def test_gate(spark):
    rows = [("f", "base", 0, "Do not enter before all customers left", "Do enter before all customer left"), ("f", "base", 1, "for ten minutes", "for 10 minutes"), ("g", "base", 0, "", ""), ("h", "base", 0, "one two three", "six")]
    shots = gate.judged(spark.createDataFrame(rows, "fixture string, branch string, shot_no int, expected string, recognized string"))
    missing = gate.missing_markers(shots)
    assert [(r.fixture, r.shot_no, r.category, r.marker) for r in missing.collect()] == [("f", 0, "negation", "not")]
    out = {r.fixture: (r.soft_clean, r.semantically_clean, r.eligible) for r in gate.fixture_rollup(gate.video_rollup(shots, missing), shots).collect()}
    assert out == {"f": (True, False, False), "g": (True, True, True), "h": (False, True, False)}


def test_media(spark):
    segs = spark.createDataFrame([("v", 0, 0.0, 4.0, "tie"), ("v", 1, 1.5, 2.5, "late"), ("v", 2, 9.0, 9.5, "off")], "video_id string, seg_no int, start double, end double, text string")
    shots = spark.createDataFrame([("v", 0, 0.0, 2.0), ("v", 1, 2.0, 4.0)], "video_id string, sequence_index int, start double, end double")
    got = media.attach_segments(segs, shots)
    assert sorted((r.seg_no, r.sequence_index) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert {r.sequence_index: r.transcript for r in media.shot_transcripts(got).collect()} == {0: "tie late", 1: "tie late"}
    frames = spark.createDataFrame([("v", i, float(i), 90.0 if i in (0, 3) else 1.0) for i in range(6)] + [("w", 9, 1.0, 0.0)], "video_id string, frame int, ts double, delta double")
    cuts = media.segment_shots(frames)
    assert sorted(tuple(r) for r in cuts.collect()) == [("v", 0, 0.0, 3.0), ("v", 1, 3.0, 5.0)]
    assert sorted((r.sequence_index, r.frame) for r in media.keyframes(cuts, frames).collect()) == [(0, 1), (1, 4)]
    reason = media.normalization_reason(*[F.col(c) for c in ("codec", "w", "h", "fps", "audio")])
    videos = [("h264", 4, 4, 30.0, "aac"), ("vp9", 4, 4, 30.0, "aac"), ("h264", 0, 4, 30.0, None), ("h264", 3, 4, 30.0, None), ("h264", 4, 4, 0.0, None), ("h264", 4, 4, 1.0, "mp3")]
    assert [r[0] for r in spark.createDataFrame(videos, "codec string, w int, h int, fps double, audio string").select(reason).collect()] == [None, "video codec", "non-positive dimensions", "odd dimensions", "non-positive fps", "audio codec"]
    pixels = spark.createDataFrame([(1, 0, 64, 255), (1, 255, 64, 0)], "frame int, r int, g int, b int")
    stats = media.frame_statistics(pixels).first()
    assert stats.rgb == pytest.approx([0.5, 64 / 255, 0.5]) and sum(stats.hist) == pytest.approx(1.0) and stats.hist[5] == pytest.approx(1 / 3)
    image = spark.createDataFrame([([float(i % 32) for i in range(1024)], [255.0, 0.0, 128.0]), (None, None)], "p array<double>, m array<double>")
    hashes = [r[0] for r in image.select(media.perceptual_hash(F.col("p"), F.col("m"))).collect()]
    assert len(hashes[0]) == 16 and f"{int(hashes[0], 16):064b}"[:9] == "111000100" and hashes[1] == "0" * 16


def test_validation_and_scripts(spark):
    raw = spark.createDataFrame([(1, '```json\n{"a": 1, "b": "x"}\n```'), (2, '{"a": 1}'), (3, '{"a": 1, "b": "x", "c": 2}'), (4, "oops")], "id int, raw string")
    _, problem = validate.closed_json(F.col("raw"), "a int, b string", ["a", "b"])
    sound, refused = validate.quarantine(raw, problem)
    assert [r.id for r in sound.collect()] == [1] and {r.id: r.problem for r in refused.collect()} == {2: "missing key", 3: "unknown key", 4: "malformed"}
    lines = spark.createDataFrame([("s", "a", i, f"l{i}") for i in range(4)], "name string, branch string, line_index int, text string")
    script = spark.createDataFrame([("s", "a", 0, "DELETE", None), ("s", "a", 1, "REPLACE", "new"), ("s", "a", 2, "WEAKEN", None)], "name string, branch string, line_index int, edit string, replacement string")
    out = validate.surviving_positions(validate.apply_script(lines, script)).orderBy("line_index").collect()
    assert [(r.line_index, r.text, r.branch_position) for r in out] == [(1, "new", 0), (2, "l2", 1), (3, "l3", 2)]


def test_files(spark, tmp_path):
    import hashlib

    big = bytes(range(256)) * 10_000
    (tmp_path / "in").mkdir()
    for name, data in (("a.mp4", big), ("b.MP4", b"abc"), ("c.mp4", b""), ("d.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    got = files.scan_uploads(spark, str(tmp_path / "in"), 3_000_000)
    assert {r.path[-5:]: r.reject for r in got.collect()} == {"a.mp4": None, "b.MP4": None, "d.txt": "unsupported media type"}
    ids = {r.path[-5:]: r.h for r in got.select("path", files.content_hash(F.col("content"), F.col("length")).alias("h")).collect()}
    mib = 1 << 20
    assert ids["a.mp4"] == hashlib.sha256(str(len(big)).encode() + big[:mib] + big[-mib:]).hexdigest()[:16]
    assert ids["b.MP4"] == hashlib.sha256(b"3abc").hexdigest()[:16]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "1.json").write_text('{"video_id": "v1", "width": 4, "shots": [{"shot_id": "shot_0000", "start": 0, "end": 1, "transcript": "hi"}]}')
    (tmp_path / "cache" / "2.json").write_text("{broken")
    cached = files.read_representations(spark, str(tmp_path / "cache")).cache()
    todo = files.not_cached(spark.createDataFrame([("v1",), ("v2",)], "video_id string"), cached)
    assert [r.video_id for r in todo.collect()] == ["v2"]
    files.write_json(spark.createDataFrame([("f", 1)], "fixture string, n int"), str(tmp_path / "out"), "fixture")
    assert spark.read.json(str(tmp_path / "out")).first().n == 1
    probe = '{"streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 4, "height": 2, "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001"}], "format": {"duration": "6.5", "bit_rate": "x"}}'
    r = spark.range(1).select(files.parse_probe(F.lit(probe)).alias("p")).first().p
    assert (r.duration_seconds, r.width, r.codec, r.audio_present, r.audio_codec, r.bit_rate) == (6.5, 4, "h264", True, "aac", None) and r.fps == pytest.approx(29.97, abs=0.01)
