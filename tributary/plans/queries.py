"""Registered queries over the given tables: one for each operator family of the analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary import config
from tributary.functions import similarity as S
from tributary.functions import text as T
from tributary.operators import align, claims, evaluate, gate, media, merge, render, validate
from tributary.plans.flow import MergeFlow
from tributary.sources import derived, files


def r6(column):
    return F.round(column, 6)


def _flow(build):
    return lambda spark, sf_dir: build(MergeFlow(spark, sf_dir))


def q01(f):
    p = f.base_prints
    return p.select("merge_id", "base_index", r6("start").alias("start"), r6("end").alias("end"), "normalized", F.size("tokens").alias("n_tokens"), "has_speech")


def segments(f):
    """Transcript segments of BASE shots: each text in three parts, with times that straddle the shots' borders."""
    words = F.regexp_extract_all("text", F.lit("[^ \t-\r]+"), F.lit(0))
    rows = f.base.withColumn("w", words).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2))))
    n = F.size("w")
    a, b = F.floor(n * F.col("part") / 3).cast("int"), F.floor(n * (F.col("part") + 1) / 3).cast("int")
    rows = rows.withColumn("a", a).withColumn("b", b).where("b > a")
    return rows.select(
        F.col("merge_id").alias("video_id"), (F.col("base_index") * 3 + F.col("part")).alias("seg_no"),
        (F.col("start") + F.col("a") * 0.4 - 0.3).alias("start"), (F.col("start") + F.col("b") * 0.4 + 0.5).alias("end"), F.array_join(F.slice("w", F.col("a") + 1, F.col("b") - F.col("a")), " ").alias("text"),
    )


def video_shots(f):
    return f.base.select(F.col("merge_id").alias("video_id"), F.col("base_index").alias("sequence_index"), "start", "end")


def q02(f):
    j = media.attach_segments(segments(f), video_shots(f))
    return media.shot_transcripts(j)


def q03(f):
    doubled = F.when(F.col("base_index") % 2 == 0, F.concat("tokens", "tokens")).otherwise(F.col("tokens"))
    return f.base_prints.withColumn("t", doubled).withColumn("c", T.let(F.col("t"), T.collapse_repeats)).select("merge_id", "base_index", F.size("t").alias("n_tokens"), F.size("c").alias("n_collapsed"), F.array_join("c", " ").alias("collapsed"))


def q04(f):
    return f.pairs.select("merge_id", "branch", "base_index", "branch_index", S.hamming(F.col("b_hash"), F.col("r_hash")).alias("hamming"), r6("structure").alias("structure"))


def q05(f):
    return f.pairs.select("merge_id", "branch", "base_index", "branch_index", r6("hist").alias("hist"))


def q06(f):
    return f.pairs.select("merge_id", "branch", "base_index", "branch_index", r6("rgb").alias("rgb"))


def q07(f):
    return f.pairs.select("merge_id", "branch", "base_index", "branch_index", r6("visual").alias("visual"))


def q08(f):
    return f.pairs.select("merge_id", "branch", "base_index", "branch_index", r6("transcript").alias("transcript"))


def q09(f):
    return f.pairs.select("merge_id", "branch", "base_index", "branch_index", r6("dur").alias("dur"), r6("rel_gap").alias("rel_gap"), r6("order_prior").alias("order_prior"))


def q10(f):
    used = S.used_components(*[F.col(c) for c in ("visual", "transcript", "dur", "order_prior")])
    return f.pairs.select("merge_id", "branch", "base_index", "branch_index", r6("score").alias("score"), used.alias("used"))


def q11(f):
    return f.pairs.groupBy("merge_id", "branch").agg(F.count("*").alias("n_pairs"), r6(F.max("score")).alias("best"), r6(F.min("score")).alias("worst"))


def q12(f):
    return align.alignment_steps(f.base, f.branch, f.scored, derived.BRANCHES)


def q13(f):
    return f.matches.select("merge_id", "branch", "step", "base_index", "branch_index", "operation", r6("confidence").alias("confidence"), "used")


def q14(f):
    return align.neighbours(f.matches).select("merge_id", "branch", "step", "operation", "previous_match", "next_match")


def q15(f):
    return f.units.select("merge_id", "branch", "base_index", "kind", "replacement_text", "retained_text")


def q16(f):
    return f.attached.select("merge_id", "branch", "branch_index", r6("start").alias("start"), "anchor")


def q17(f):
    return f.slices.select("merge_id", "base_index", "a_kind", "b_kind", F.col("n_inserts").alias("n_inserts"), "verdict", "combined_text")


def q18(f):
    return merge.text_lines(f.slices, "base_index", "combined_text", ["merge_id"])


def q19(f):
    return f.branch_views.select("merge_id", "branch", "base_index", "operation", "text", "deleted")


def q20(f):
    return f.combined.select("merge_id", "base_index", "operation", "text", "deleted", r6("confidence").alias("confidence"))


def q21(f):
    return merge.text_lines(merge.four_views(f.base, f.branch_views, f.combined), "base_index", "text", ["merge_id", "view"])


def q22(f):
    return merge.marker_view(f.base, f.matches)


def q23(f):
    return f.projected.select("merge_id", "claim_id", "branch", "kind", r6("start").alias("start"), r6("end").alias("end"))


def q24(f):
    return claims.intersect(f.projected).select("merge_id", "claim_id", "kind", r6("start").alias("start"), r6("end").alias("end"))


def q25(f):
    return f.surrogate.select("merge_id", "claim_id", "view", "n_regions", "status")


def q26(f):
    return f.verdicts.select("merge_id", "claim_id", "view", "status", r6("confidence").alias("confidence"), "surrogate")


def q27(f):
    return f.interactions.select("merge_id", "claim_id", "claim_type", "importance", "a_status", "b_status", "c_status", "interaction", "rule_id", "explanation")


def q28(f):
    o = claims.overall(f.base.select("merge_id"), f.interactions, f.verdicts)
    return o.withColumn("overall_confidence", r6("overall_confidence"))


def q29(f):
    return f.verdicts.groupBy("view", "status").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))


def q30(f):
    """One flat record for each claim: its BASE evidence, statuses and what the combination says there."""
    evidence = f.regions.groupBy("merge_id", "claim_id").agg(F.count("*").alias("n_regions"), r6(F.min("start")).alias("first_start"), r6(F.max("end")).alias("last_end"))
    said = f.claims.select("merge_id", "claim_id", "base_index").join(f.combined.select("merge_id", "base_index", F.col("text").alias("combined_text")), ["merge_id", "base_index"])
    return f.interactions.select("merge_id", "claim_id", "interaction", "c_status").join(evidence, ["merge_id", "claim_id"]).join(said, ["merge_id", "claim_id"])


def q31(f):
    m = evaluate.modal(f.runs, ["fixture"], "interaction", "run")
    e = f.runs.select("fixture", F.col("interaction_expected").alias("expected")).distinct()
    return m.join(e, "fixture").select("fixture", F.col("interaction").alias("modal"), "expected", (F.col("interaction") == F.col("expected")).alias("correct"))


def q32(f):
    m = evaluate.modal(f.runs, ["fixture"], "interaction", "run").select("fixture", "variance", "n_runs")
    right = f.runs.groupBy("fixture").agg(F.count_if(F.col("interaction") == F.col("interaction_expected")).alias("n_correct"))
    return m.join(right, "fixture").join(evaluate.distribution(f.runs, ["fixture"], "interaction"), "fixture")


def _statuses(f):
    return f.runs.select("fixture", "run", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"{v}_status").alias("status")) for v in "abc"])).alias("s")).select("fixture", "run", "s.view", "s.status")


def q33(f):
    return evaluate.modal(_statuses(f), ["fixture", "view"], "status", "run").select("fixture", "view", F.col("status").alias("modal"), "variance", "n_runs")


def q34(f):
    m = evaluate.modal(_statuses(f), ["fixture", "view"], "status", "run")
    wide = m.groupBy("fixture").agg(*[F.max(F.when(F.col("view") == v, F.col("status"))).alias(f"{v}_modal") for v in "abc"])
    e = f.runs.select("fixture", *[f"{v}_expected" for v in "abc"]).distinct()
    acc = evaluate.axis_accuracy(wide.join(e, "fixture"), ["a", "b", "c"])
    return acc.withColumn("accuracy", r6("accuracy"))


def q35(f):
    first = f.runs.where("run = 0")
    label = F.when((F.col("a_status") == "degraded") & (F.col("b_status") == "degraded"), F.lit(None).cast("string")).when(F.col("c_status") == "broken", "conflict").otherwise("safe")
    rows = first.select(
        label.alias("label"), F.when(F.col("c_expected") == "broken", "conflict").otherwise("safe").alias("expected_label"),
        (F.col("a_status") == "preserved").alias("a_safe"), (F.col("b_status") == "preserved").alias("b_safe"), (F.col("a_expected") == "preserved").alias("a_safe_expected"), (F.col("b_expected") == "preserved").alias("b_safe_expected"),
    )
    return evaluate.spike_gate(rows)


def q36(f):
    a = evaluate.alignment_acceptance(f.matches, f.script)
    return a.select("branch", "slots", *[r6(c).alias(c) for c in ("slot_accuracy", "required_accuracy", "localisation")], "false_edits", "low_confidence", "uncertain")


def gate_lines(f):
    """Expected and recognised lines with marker phrases put in by hash, so the scan has something to find."""
    phrases = [m for group in config.MARKERS.values() for m in group]
    pick = F.element_at(F.array(*map(F.lit, phrases)), (derived.draw(F.col("fixture"), F.col("branch"), F.col("shot_no")) % len(phrases) + 1).cast("int"))
    keep = derived.draw(F.col("shot_no"), F.col("fixture")) % 3 > 0
    rows = gate.derived_gate_shots(f.base, f.branch, f.matches).withColumn("m", pick)
    rows = rows.withColumn("expected", F.concat_ws(" ", "expected", "m")).withColumn("recognized", F.when(keep, F.concat_ws(" ", "recognized", "m")).otherwise(F.col("recognized")))
    return gate.judged(rows)


def q37(f):
    return gate.missing_markers(gate_lines(f))


def q38(f):
    return f.gate_shots.select("fixture", "branch", "shot_no", r6("similarity").alias("similarity"))


def _gate(f):
    rows = files.materialized(gate_lines(f))
    return rows, gate.video_rollup(rows, gate.missing_markers(rows))


def q39(f):
    _, v = _gate(f)
    return v.select("fixture", "branch", "shots", r6("avg_similarity").alias("avg_similarity"), r6("min_similarity").alias("min_similarity"), "flagged", "categories")


def q40(f):
    rows, v = _gate(f)
    return gate.fixture_rollup(v, rows).withColumn("min_similarity", r6("min_similarity"))


def q41(f):
    return f.attempts.where("not ok").groupBy("category", "error_class").agg(F.count("*").alias("n"), r6(F.sum("elapsed")).alias("elapsed"))


def q42(f):
    return evaluate.attempt_window(f.attempts).select("fixture", "attempt", "ok", "category")


def q43(f):
    done = F.count_if(F.col("ok"))
    days = f.table("events").withColumn("ok", F.col("event_type") != "error").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = days.groupBy("user_id", "day").agg(done.alias("successes"), F.count_if(~F.col("ok")).alias("failures"))
    w = F.sum
    from pyspark.sql import Window as W

    running = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    snapshots = daily.select("user_id", "day", w("successes").over(running).alias("successes"), w("failures").over(running).alias("failures"))
    return evaluate.counter_deltas(snapshots, ["user_id"], "day", ["successes", "failures"])


def q44(f):
    return merge.candidate_pairs(f.matches)


def q45(f):
    rows = claims.overall(f.base.select("merge_id"), f.interactions, f.verdicts)
    side = lambda v: f.verdicts.where(F.col("view") == v).groupBy("merge_id").agg(F.min((F.col("status") == "preserved").cast("int")).alias(f"{v}_safe"))
    out = rows.select("merge_id", "conflict")
    for v in ("branch_a", "branch_b", "combined"):
        out = out.join(side(v), "merge_id", "left").withColumn(f"{v}_safe", F.coalesce(F.col(f"{v}_safe"), F.lit(1)) == 1)
    return out


def q46(f):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = F.from_json(T.unfenced_json(raw), "k long")
    return f.table("events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNull().alias("failed"))


def q47(f):
    e = f.table("events")
    raw = F.when(F.col("event_id") % 5 == 0, F.regexp_replace("props", "}", ', "x": 1}')).when(F.col("event_id") % 11 == 0, F.lit("{}")).when(F.col("event_id") % 13 == 0, F.lit("oops")).otherwise(F.col("props"))
    _, problem = validate.closed_json(raw, "k long", ["k"])
    return e.select("event_id", problem.alias("problem")).groupBy(F.coalesce("problem", F.lit("sound")).alias("problem")).agg(F.count("*").alias("n"))


def q48(f):
    p = f.table("part")
    codec = F.element_at(F.array(*map(F.lit, ["h264", "libx264", "hevc", "h264"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    audio = F.element_at(F.array(F.lit("aac"), F.lit(None).cast("string"), F.lit("mp3")), (F.col("p_partkey") % 3 + 1).cast("int"))
    reason = media.normalization_reason(codec, F.col("p_size") * 8, F.col("p_size") * 6 + F.col("p_partkey") % 5, F.col("p_partkey") % 31, audio)
    return p.select(F.col("p_partkey").alias("video_id"), reason.alias("reason"), reason.isNotNull().alias("normalized"))


def frames(f):
    """Events as frames: a user's timeline in seconds, the value as content change."""
    return f.table("events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("ts"), F.col("value").alias("delta"))


def q49(f):
    s = media.segment_shots(frames(f))
    return s.select("video_id", "sequence_index", r6("start").alias("start"), r6("end").alias("end"))


def q50(f):
    return media.keyframes(media.segment_shots(frames(f)), frames(f)).select("video_id", "sequence_index", "frame")


def _script(f):
    lines = f.base.select(F.col("merge_id").alias("name"), F.col("base_index").alias("line_index"), "text")
    lines = lines.withColumn("branch", F.explode(F.array(*map(F.lit, derived.BRANCHES))))
    edit = F.when(F.col("edit") == "delete", "DELETE").when(F.col("edit") == "replace", "REPLACE").when(F.col("edit") == "trim", "WEAKEN").otherwise("KEEP")
    replacement = F.when(F.col("edit") == "replace", F.concat(F.lit("line "), F.col("draw").cast("string")))
    script = f.script.select(F.col("merge_id").alias("name"), "branch", F.col("base_index").alias("line_index"), edit.alias("edit"), replacement.alias("replacement"))
    return validate.apply_script(lines, script)


def q51(f):
    return _script(f)


def q52(f):
    return validate.surviving_positions(_script(f)).select("name", "branch", "line_index", "branch_position")


PHRASES = [("thanks", 0, "thank"), ("thanks", 0, "the"), ("french", 1, "tion"), ("french", 1, "eau"), ("german", 2, "sch"), ("german", 2, "ung"), ("spanish", 3, "ción")]


def q53(f):
    phrases = f.spark.createDataFrame(PHRASES, "name string, ord int, phrase string")
    texts = f.base.select(F.concat_ws(":", "merge_id", "base_index").alias("text_id"), "text")
    return validate.best_marked(texts, phrases)


def q54(f):
    first = f.runs.where("run = 0")
    c = evaluate.confusion(first, F.col("interaction_expected") == "creates_new_conflict", F.col("interaction") == "creates_new_conflict")
    return c.select("tp", "fp", "fn", "tn", *[r6(x).alias(x) for x in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")])


def q55(f):
    return gate.judged(f.base.select(F.col("merge_id").alias("fixture"), F.lit("base").alias("branch"), F.col("base_index").alias("shot_no"), F.concat_ws(" ", "text", F.lit("Seven allergies, customers' boxes and glasses")).alias("expected"), F.lit("").alias("recognized"))).select(
        "fixture", "shot_no", F.size("e").alias("n_tokens"), F.array_join(F.array_sort("e"), " ").alias("tokens")
    )


def q56(f):
    """Text of BASE written as clock lines and parsed back."""
    mmss = lambda c: F.format_string("%02d:%02d", F.floor(F.col(c) / 60), F.floor(F.col(c)) % 60)
    line = F.concat(F.lit("["), mmss("start"), F.lit("–"), mmss("end"), F.lit("] '"), T.collapse_whitespace(F.col("text")), F.lit("'"))
    return f.base.select("merge_id", "base_index", F.explode(T.parse_clock_lines(F.concat(line, F.lit("\nnot a line")))).alias("s")).select("merge_id", "base_index", "s.start", "s.end", "s.text")


def q57(f):
    """Replies of the event log's properties: the event's own texts as status lines and bodies."""
    e = f.table("events")
    failed = F.col("event_type") == "error"
    message = F.concat_ws(" ", "event_type", "props")
    return e.select("event_id", evaluate.retryable(F.when(failed, 503).otherwise(200), message).alias("retryable"), evaluate.backoff(F.lit(1), F.when(F.col("value") > 50, F.col("value"))).alias("wait"))


def q58(f):
    return merge.edit_metadata(f.matches).withColumn("confidence", r6("confidence"))


def q59(f):
    """Positions claimed twice and inserts without a BASE anchor: both counts are zero for a sound table."""
    twice = merge.check_unique(f.units).agg(F.count("*").alias("duplicates"))
    orphans = merge.orphan_inserts(f.attached, f.base).agg(F.count("*").alias("orphans"))
    return twice.join(orphans)


def q60(f):
    return render.evidence(f.matches)


def q61(f):
    return render.extraction_payload(f.base)


def q62(f):
    views = merge.four_views(f.base, f.branch_views, f.combined)
    return render.evaluation_payload(f.claims, f.base, views)


def q63(f):
    """Each shot's whole text written as a clock line beside a neighbour and rebuilt from prose that marks it by hash."""
    mmss = lambda c: F.format_string("%02d:%02d", F.floor(F.col(c) / 60), F.floor(F.col(c)) % 60)
    rows = f.base.where("n_words > 0").withColumn("t", T.collapse_whitespace(F.col("text")))
    line = F.concat(F.lit("["), mmss("start"), F.lit("–"), mmss("end"), F.lit("] '"), "t", F.lit("'"))
    mark = F.element_at(F.array(*map(F.lit, ["--> DELETED", "--> REPLACED", "--> TRIMMED", "stays"])), (derived.draw(F.col("merge_id"), F.col("base_index"), F.lit("prose")) % 4 + 1).cast("int"))
    prose = F.concat(F.lit("The line '"), "t", F.lit("' is\nedited "), mark)
    return rows.select("merge_id", "base_index", render.reconstruct_from_prose(F.concat(line, F.lit("\n[00:00–00:01] 'kept.'")), prose).alias("rebuilt"))


def q64(f):
    inside = segments(f).withColumn("sequence_index", F.floor(F.col("seg_no") / 3))
    local = inside.join(video_shots(f).select("video_id", "sequence_index", F.col("start").alias("s")), ["video_id", "sequence_index"])
    local = local.select("video_id", "sequence_index", "seg_no", (F.col("start") - F.col("s")).alias("start"), (F.col("end") - F.col("s")).alias("end"), "text")
    out = render.to_video_time(local, video_shots(f))
    return out.withColumn("start", r6("start")).withColumn("end", r6("end"))


BUILDERS = {
    "q01_shots_timeline": q01, "q02_segment_overlap_join": q02, "q03_tokens_collapse": q03, "q04_hamming": q04, "q05_histogram_intersection": q05, "q06_mean_rgb": q06,
    "q07_visual_blend": q07, "q08_multiset_jaccard": q08, "q09_duration_order": q09, "q10_final_blend": q10, "q11_pair_matrix": q11, "q12_alignment_steps": q12,
    "q13_edit_ops": q13, "q14_neighbours": q14, "q15_edit_sets": q15, "q16_insert_attach": q16, "q17_compose": q17, "q18_combined_text": q18, "q19_branch_view": q19,
    "q20_combined_view": q20, "q21_four_views": q21, "q22_marker_view": q22, "q23_claim_projection": q23, "q24_claim_intersection": q24, "q25_surrogate": q25,
    "q26_verdict_join": q26, "q27_interactions": q27, "q28_overall": q28, "q29_confidence": q29, "q30_api_projection": q30, "q31_modal": q31, "q32_variance": q32,
    "q33_per_claim_modal": q33, "q34_axis_accuracy": q34, "q35_spike_gate": q35, "q36_alignment_acceptance": q36, "q37_marker_scan": q37, "q38_gate_similarity": q38,
    "q39_gate_rollup": q39, "q40_eligibility": q40, "q41_failure_class": q41, "q42_attempt_window": q42, "q43_counter_delta": q43, "q44_candidate_pairs": q44,
    "q45_legacy_projection": q45, "q46_json_tolerant": q46, "q47_validation_quarantine": q47, "q48_normalization_reason": q48, "q49_segmentation_islands": q49,
    "q50_keyframe_asof": q50, "q51_apply_edit_script": q51, "q52_base_identity_rank": q52, "q53_marker_argmax": q53, "q54_precision_recall": q54, "q55_gate_tokens": q55,
    "q56_clock_lines": q56, "q57_retry_policy": q57, "q58_edit_metadata": q58, "q59_soundness": q59,
    "q60_evidence": q60, "q61_extraction_payload": q61, "q62_evaluation_payload": q62, "q63_prose_reconstruction": q63, "q64_shot_time_shift": q64,
}

QUERIES = {name: _flow(build) for name, build in BUILDERS.items()}
