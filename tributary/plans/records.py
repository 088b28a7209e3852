"""Registered queries over records: validation, caches, media rows, client records, evaluation lists; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary import config
from tributary.functions import text as T
from tributary.operators import artifacts, claims, evaluate, gate, media, merge, render, validate
from tributary.plans import oracle
from tributary.plans.flow import MergeFlow
from tributary.plans.queries import _flow, _gate, gate_lines, r6, segments
from tributary.sources import derived, files


def _defect(*parts):
    return derived.draw(*map(F.col, parts), F.lit("defect"))


def q65(f):
    """Claim records written as JSON, some with a defect by hash, judged."""
    rows = f.claims.join(f.base.select("merge_id", "base_index", "text", "start", "end"), ["merge_id", "base_index"]).withColumn("h", _defect("merge_id", "claim_id")).withColumn("d", F.col("h") % 11)
    kind = F.element_at(F.array(*map(F.lit, config.CLAIM_TYPES)), (F.floor(F.col("h") / 11) % 10 + 1).cast("int"))
    d = F.col("d")
    region = F.struct("start", F.when(d == 2, F.col("start") - 1).otherwise(F.col("end")).alias("end"), F.when(d == 3, "").otherwise("said").alias("description"))
    record = F.to_json(
        F.struct(
            "claim_id", F.col("text").alias("meaning"), F.when(d == 0, "fiction").when(d != 5, kind).alias("claim_type"), F.when(d == 1, "urgent").otherwise(F.col("importance")).alias("importance"),
            F.array(region).alias("evidence_regions"), F.array().cast("array<string>").alias("equivalents"),
        )
    )
    raw = F.when(d == 6, "oops").when(d == 4, F.regexp_replace(record, r"\}$", ',"extra":1}')).otherwise(record)
    return rows.select("merge_id", "claim_id", validate.claim_problem(raw).alias("problem"))


def q66(f):
    """Verdict records written as JSON, some with a defect by hash, judged."""
    d = _defect("merge_id", "claim_id", "view") % 7
    region = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.when(d == 3, "").otherwise("said").alias("description"))
    raw = F.to_json(
        F.struct("claim_id", F.when(d == 0, "merged").otherwise(F.col("view")).alias("branch"), F.when(d == 1, "lost").otherwise(F.col("status")).alias("status"), F.when(d == 2, "").otherwise(F.col("rationale")).alias("rationale"), F.array(region).alias("surviving_evidence"))
    )
    return f.verdicts.select("merge_id", "claim_id", "view", validate.survival_problem(raw).alias("problem"))


def q67(f):
    """Dry-run payloads of the expected labels, some with a defect by hash, judged and read back."""
    rows = f.runs.select("fixture", "a_expected", "b_expected", "c_expected", "interaction_expected").distinct().withColumn("d", _defect("fixture") % 4)
    raw = validate.expected_payload(*[F.col(f"{x}_expected") for x in ("a", "b", "c", "interaction")])
    raw = F.when(F.col("d") == 0, F.replace(raw, F.lit('"overall_confidence":1.0'), F.lit('"overall_confidence":1.5'))).when(F.col("d") == 1, F.replace(raw, F.lit("prerequisite_loss"), F.lit("loss"))).when(F.col("d") == 2, F.replace(raw, F.lit('"description":"synthetic"'), F.lit('"description":""'))).otherwise(raw)
    at = lambda k: F.get_json_object("raw", k)
    return rows.withColumn("raw", raw).select(
        "fixture", validate.analysis_problem(F.col("raw")).alias("problem"), at("$.branch_a_impact.impact_level").alias("a_impact"), at("$.branch_b_impact.impact_level").alias("b_impact"), at("$.combined_impact").alias("combined_impact"),
        at("$.interactions[0].interaction_type").alias("interaction"), at("$.interactions[0].conflict_type").alias("conflict_type"),
    )


def q68(f):
    """Interactions where no provider gave a verdict: what the merge itself did to the claims."""
    alone = MergeFlow(f.spark, f.sf_dir, verdicts=False)
    return alone.interactions.select("merge_id", "claim_id", "a_status", "b_status", "c_status", "interaction", "rule_id")


def q69(f):
    """Statuses of claims that come as a table of nested records."""
    shots = f.base.select("merge_id", "base_index", "text", "start", "end")
    spot = lambda kind: F.filter("r", lambda x: x["kind"] == kind)
    plain = lambda kind: F.transform(spot(kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("description")))
    found = claims.claim_regions(f.claims, f.base).groupBy("merge_id", "claim_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("r"))
    records = f.claims.join(shots, ["merge_id", "base_index"]).join(found, ["merge_id", "claim_id"])
    records = records.select("merge_id", "claim_id", F.col("text").alias("meaning"), "claim_type", "importance", plain("evidence").alias("evidence_regions"), plain("equivalent").alias("equivalents"))
    return MergeFlow(f.spark, f.sf_dir, claim_records=records).surrogate.select("merge_id", "claim_id", "view", "n_regions", "status")


def _claim_rows(f):
    said = f.claims.join(f.base.select("merge_id", "base_index", T.collapse_whitespace(F.col("text")).alias("claim")), ["merge_id", "base_index"]).select("merge_id", "claim_id", "claim")
    return artifacts.claim_responses(f.interactions, said, f.regions, f.projected, f.verdicts)


def _totals(f):
    return claims.overall(f.base.select("merge_id"), f.interactions, f.verdicts)


def _timeline(f):
    return artifacts.timeline(f.slices, f.attached)


SPAN = "array<struct<start:double,end:double,description:string>>"
EFFECT = f"struct<status:string,rationale:string,evidence:{SPAN}>"


def q70(f):
    """Every merge's JSON answer, read back claim by claim."""
    answer = artifacts.responses(_totals(f), _claim_rows(f), _timeline(f))
    schema = f"conflict_detected boolean, summary string, claims array<struct<claim_id:string,claim:string,base_evidence:{SPAN},branch_a:{EFFECT},branch_b:{EFFECT},combined:{EFFECT},interaction:string,deterministic_rule:string>>, combined_timeline array<struct<base_index:long>>"
    rows = answer.select("merge_id", F.from_json("response", schema).alias("r")).select("merge_id", "r.conflict_detected", "r.summary", F.size("r.combined_timeline").cast("long").alias("n_slices"), F.explode("r.claims").alias("c"))
    where = F.array_join(F.transform("c.base_evidence", lambda e: F.concat(e["description"], F.lit("@"), F.round(e["start"] * 1000).cast("long").cast("string"))), ",")
    views = [F.col(f"c.{v}.{x}").alias(f"{v}_{x}") for v in ("branch_a", "branch_b", "combined") for x in ("status", "rationale")]
    sizes = [F.size(f"c.{v}.evidence").cast("long").alias(f"{v}_evidence") for v in ("branch_a", "branch_b", "combined")]
    return rows.select("merge_id", "conflict_detected", "summary", "n_slices", "c.claim_id", "c.claim", where.alias("base_evidence"), *views, *sizes, "c.interaction", "c.deterministic_rule")


def q71(f):
    return _timeline(f).select("merge_id", "base_index", r6("start").alias("start"), r6("end").alias("end"), "verdict", "text", "reason")


def _video_rows(f):
    """Events as the frames and words of a user's video, which starts with the first event."""
    e = f.table("events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("delta"), "event_type")
    first = e.groupBy("video_id").agg(F.min("us").alias("first_us"), ((F.max("us") - F.min("us")) / F.lit(1000000.0)).alias("duration"))
    rows = e.join(first, "video_id").withColumn("ts", (F.col("us") - F.col("first_us")) / F.lit(1000000.0))
    words = rows.select("video_id", F.col("frame").alias("seg_no"), F.col("ts").alias("start"), (F.col("ts") + 3600.0).alias("end"), F.col("event_type").alias("text"))
    return rows.select("video_id", "frame", "ts", "delta"), first.select("video_id", "duration"), words


def q72(f):
    rows = media.process_video(*_video_rows(f))
    return rows.select("video_id", "sequence_index", "shot_id", r6("start").alias("start"), r6("end").alias("end"), "keyframe", "transcript", "n_segments")


def q73(f):
    """Transcripts written to the cache, some with an invalid row by hash, and read back."""
    h = derived.draw(F.col("video_id"), F.col("seg_no"), F.lit("cache")) % 50
    rows = segments(f).select(F.col("video_id").cast("string").alias("fingerprint"), F.greatest("start", F.lit(0.0)).alias("start"), "end", F.when(h != 0, F.col("text")).alias("text"), F.when(h == 1, 1.5).otherwise(0.5).alias("confidence"))
    path = files.work_folder(f.spark)
    files.write_transcripts(rows, path)
    back = files.read_transcripts(f.spark, path)
    text = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    return back.select("fingerprint", F.col("segments").isNotNull().alias("hit"), F.when(F.col("segments").isNotNull(), F.size("segments")).cast("long").alias("n"), text.alias("text"))


def q74(f):
    """Representations written to the cache, some torn by hash; the videos that must be processed again."""
    shots = f.base.select(F.col("merge_id").alias("video_id"), F.col("base_index").alias("sequence_index"), F.format_string("shot_%04d", "base_index").alias("shot_id"), "start", "end", F.col("text").alias("transcript"))
    kept = media.representations(shots, f.base.groupBy(F.col("merge_id").alias("video_id")).agg(F.max("end").alias("duration")))
    record = F.to_json(F.struct(*kept.columns))
    torn = derived.draw(F.col("video_id"), F.lit("torn")) % 3 == 0
    path = files.work_folder(f.spark)
    kept.select(F.when(torn, F.substring(record, 1, 20)).otherwise(record).alias("value")).write.text(path)
    cached = files.read_representations(f.spark, path, lines=True)
    return files.not_cached(kept.select("video_id"), cached).select("video_id")


def q75(f):
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = f.table("documents").select("doc_id", content.alias("content"))
    return rows.select("doc_id", files.content_hash(F.col("content"), F.octet_length("content")).alias("content_hash"), files.file_hash(F.col("content")).alias("file_hash"))


def q76(f):
    """Probe JSON made of parts, read."""
    k = F.col("p_partkey")
    audio = F.when(k % 2 == 0, F.lit('{"codec_type":"audio","codec_name":"aac"},')).otherwise("")
    video = F.format_string('{"codec_type":"video","codec_name":"h264","width":%d,"height":%d,"avg_frame_rate":"%d/%d","r_frame_rate":"25/1"}', F.col("p_size") * 8, F.col("p_size") * 6, k % 60, k % 3)
    raw = F.concat(F.lit('{"streams":['), audio, video, F.lit('],"format":{"duration":"'), F.col("p_size").cast("string"), F.lit('.5","bit_rate":"'), k.cast("string"), F.lit('"}}'))
    rows = f.table("part").select(k.alias("video_id"), files.parse_probe(F.when(k % 7 == 0, "oops").otherwise(raw)).alias("p")).select("video_id", "p.*")
    return rows.withColumn("fps", r6("fps"))


def q77(f):
    """Mean colour and histogram of frames whose pixels are an embedding's components."""
    e = f.table("embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("e")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("e") - 1)))
    level = lambda by: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.element_at("e", ((F.col("i") + by) % F.size("e") + 1).cast("int")) * 256.0 + 128.0).cast("double")))
    s = media.frame_statistics(e.select("frame", level(0).alias("r"), level(21).alias("g"), level(42).alias("b")))
    return s.select("frame", *[r6(F.col("rgb")[i]).alias(c) for i, c in enumerate("rgb")], F.array_join(F.transform("hist", lambda h: F.round(h * 192).cast("long").cast("string")), ",").alias("hist"))


def q78(f):
    rows = f.runs.select("fixture", "run", *[F.col(f"{v}_status").alias(v) for v in "abc"], *[f"{v}_expected" for v in "abc"], "interaction", "interaction_expected")
    return evaluate.score_runs(rows, ["a", "b", "c", "interaction"]).select("fixture", "run", "a_correct", "b_correct", "c_correct", "interaction_correct", "all_correct")


def q79(f):
    """The modal status of each claim in each view over repeated runs; blank verdicts don't count."""
    rows = f.verdicts.select("merge_id", "claim_id", "view", F.explode(F.sequence(F.lit(0), F.lit(config.RUNS_PER_FIXTURE - 1))).alias("run"))
    h = derived.draw(F.col("merge_id"), F.col("claim_id"), F.col("view"), F.col("run")) % 4
    status = F.element_at(F.array(*map(F.lit, ["preserved", "degraded", "broken", ""])), (h + 1).cast("int"))
    m = evaluate.modal(rows.withColumn("status", status), ["merge_id", "claim_id", "view"], "status", "run")
    return m.select("merge_id", "claim_id", "view", F.col("status").alias("modal"), "variance", "n_runs")


def _spike_rows(f):
    first = f.runs.where("run = 0")
    label = F.when((F.col("a_status") == "degraded") & (F.col("b_status") == "degraded"), F.lit(None).cast("string")).when(F.col("c_status") == "broken", "conflict").otherwise("safe")
    safe = {x: F.col(f"{x}_expected") == "preserved" for x in "ab"}
    conflict = F.col("c_expected") == "broken"
    return first.select(
        F.col("fixture").alias("id"), label.alias("label"), F.when(conflict, "conflict").otherwise("safe").alias("expected_label"), *[(F.col(f"{x}_status") == "preserved").alias(f"{x}_safe") for x in "ab"],
        *[safe[x].alias(f"{x}_safe_expected") for x in "ab"], (conflict & safe["a"] & safe["b"]).alias("canonical"), (~conflict & safe["a"] & safe["b"]).alias("control"),
    )


def q80(f):
    return evaluate.spike_findings(_spike_rows(f))


def q81(f):
    """Spike records written as JSON, read again, and judged: the gate can be told anew from stored runs."""
    rows = _spike_rows(f)
    path = files.work_folder(f.spark)
    files.write_json(rows, path)
    stored = f.spark.read.schema(rows.schema).json(path)
    return evaluate.spike_decision(stored)


def q82(f):
    return evaluate.report_rows(_spike_rows(f))


def q83(f):
    return evaluate.acceptance_findings(f.matches).select("merge_id", "branch", "step", "operation", r6("confidence").alias("confidence"), "finding")


def q84(f):
    rows, videos = _gate(f)
    return gate.disqualify_reasons(videos, gate.missing_markers(rows))


def q85(f):
    return gate.soft_warnings(gate_lines(f))


def q86(f):
    return render.context_payload(f.base, f.matches, merge.candidate_pairs(f.matches))


def q87(f):
    """Forensic records of every merge, read back as counts."""
    whole = artifacts.forensics(_totals(f), _claim_rows(f), merge.four_views(f.base, f.branch_views, f.combined), merge.edit_metadata(f.matches))
    view = "struct<view:string,lines:array<struct<base_index:long>>,edit_metadata:array<struct<base_index:long>>>"
    rows = whole.select("merge_id", F.from_json("artifact", f"claims array<struct<claim_id:string>>, overall_interaction string, overall_impact string, call_counts struct<evaluation:long,explanation:long>, representation array<{view}>").alias("a"))
    total = lambda part: F.aggregate("a.representation", F.lit(0), lambda n, v: n + F.when(v[part].isNull(), 0).otherwise(F.size(v[part]))).cast("long")
    return rows.select("merge_id", F.when(F.col("a.claims").isNull(), 0).otherwise(F.size("a.claims")).cast("long").alias("n_claims"), "a.overall_interaction", "a.overall_impact", F.col("a.call_counts.evaluation").alias("evaluations"), F.col("a.call_counts.explanation").alias("explanations"), total("lines").alias("n_lines"), total("edit_metadata").alias("n_edits"))


BUILDERS = {
    "q65_claim_validation": q65, "q66_verdict_validation": q66, "q67_expected_payload": q67, "q68_surrogate_interactions": q68, "q69_claim_records": q69, "q70_api_response": q70, "q71_combined_timeline": q71,
    "q72_process_video": q72, "q73_transcript_cache": q73, "q74_representation_cache": q74, "q75_content_hash": q75, "q76_probe_json": q76, "q77_frame_statistics": q77, "q78_run_scores": q78, "q79_claim_modal": q79,
    "q80_spike_findings": q80, "q81_spike_decision": q81, "q82_spike_report": q82, "q83_acceptance_findings": q83, "q84_disqualify_reasons": q84, "q85_soft_warnings": q85, "q86_context_payload": q86, "q87_forensic_record": q87,
}

QUERIES = {name: _flow(build) for name, build in BUILDERS.items()}

_D = oracle._draw
_C = oracle._CLOCK
_SPIKE = """, spike AS (SELECT fixture AS id, CASE WHEN a_status = 'degraded' AND b_status = 'degraded' THEN NULL WHEN c_status = 'broken' THEN 'conflict' ELSE 'safe' END AS label, CASE WHEN c_expected = 'broken' THEN 'conflict' ELSE 'safe' END AS want,
  a_status = 'preserved' AS a, b_status = 'preserved' AS b, a_expected = 'preserved' AS ae, b_expected = 'preserved' AS be FROM runs WHERE run = 0),
finds AS (SELECT id, unnest(list_filter([CASE WHEN label = 'conflict' AND want = 'safe' THEN 'false_positive' END, CASE WHEN label = 'safe' AND want = 'conflict' THEN 'false_negative' END, CASE WHEN want = 'conflict' AND ae AND be AND a AND b AND label = 'conflict' THEN 'canonical_ok' END,
  CASE WHEN want = 'safe' AND ae AND be AND label = 'safe' THEN 'safe_control_ok' END, CASE WHEN NOT ae AND a THEN 'branch_a_false_negative' END, CASE WHEN ae AND NOT a THEN 'branch_a_false_positive' END, CASE WHEN NOT be AND b THEN 'branch_b_false_negative' END, CASE WHEN be AND NOT b THEN 'branch_b_false_positive' END], lambda x: x IS NOT NULL)) AS finding FROM spike WHERE label IS NOT NULL)"""
_TRUE = "CASE WHEN {c} THEN 'True' ELSE 'False' END"
_SIDE = "{e} || '/' || {g} || ' ' || CASE WHEN {x}e = {x} THEN 'OK' WHEN {x}e THEN 'FP' ELSE 'FN' END"
_SIDES = {x: _SIDE.format(e=_TRUE.format(c=f"{x}e"), g=_TRUE.format(c=x), x=x) for x in "ab"}
_TYPES = "CASE d WHEN 0 THEN 'branch' WHEN 1 THEN 'status' WHEN 3 THEN 'evidence' WHEN 2 THEN 'blank rationale' END"


def _effect(view: str) -> str:
    v = f"{view}v"
    return f"{v}.status AS {view}_status, CASE WHEN {v}.surrogate THEN '{config.SURROGATE_RATIONALE}' ELSE 'no rationale given' END AS {view}_rationale, CASE WHEN {v}.surrogate OR {v}.status = 'broken' THEN 0 ELSE coalesce({view}n.n, 0) END AS {view}_evidence"


_VIEW_JOINS = " ".join(
    f"JOIN verdicts {v}v ON {v}v.merge_id = i.merge_id AND {v}v.claim_id = i.claim_id AND {v}v.\"view\" = '{v}' LEFT JOIN alive {v}n ON {v}n.merge_id = i.merge_id AND {v}n.claim_id = i.claim_id AND {v}n.\"view\" = '{v}'" for v in ("branch_a", "branch_b", "combined")
)
_CUT = lambda x: "format('shot_{:04d}', " + x + ")"
_ID = _CUT("base_index")
_LINE = oracle.SELECTS["q22_marker_view"]


def _head(i: int) -> str:
    return "'" + render.CONTEXT_HEADS[i].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SELECTS = {
    "q65_claim_validation": f"""SELECT merge_id, claim_id, CASE WHEN d = 6 THEN 'malformed' WHEN d = 4 THEN 'unknown key' WHEN d = 5 THEN 'missing key' WHEN text = '' THEN 'blank meaning' WHEN d = 0 THEN 'claim type' WHEN d = 1 THEN 'importance' WHEN d IN (2, 3) THEN 'evidence' END AS problem
      FROM (SELECT c.merge_id, c.claim_id, b.text, {_D("c.merge_id", "c.claim_id", "'defect'")} % 11 AS d FROM claims c JOIN base b ON b.merge_id = c.merge_id AND b.base_index = c.base_index)""",
    "q66_verdict_validation": f"""SELECT merge_id, claim_id, "view", {_TYPES} AS problem FROM (SELECT *, {_D("merge_id", "claim_id", '"view"', "'defect'")} % 7 AS d FROM verdicts)""",
    "q67_expected_payload": f"""SELECT fixture, CASE WHEN d = 2 THEN 'branch_a: evidence' WHEN d = 0 THEN 'overall confidence' WHEN d = 1 AND expected = 'creates_new_conflict' THEN 'interaction' END AS problem, a_expected AS a_impact, b_expected AS b_impact, c_expected AS combined_impact, expected AS interaction,
      CASE WHEN expected = 'creates_new_conflict' THEN CASE WHEN d = 1 THEN 'loss' ELSE 'prerequisite_loss' END END AS conflict_type FROM (SELECT DISTINCT fixture, a_expected, b_expected, c_expected, expected, {_D("fixture", "'defect'")} % 4 AS d FROM runs)""",
    "q68_surrogate_interactions": """SELECT merge_id, claim_id, a_status, b_status, c_status, CASE WHEN new THEN 'creates_new_conflict' ELSE 'none' END AS interaction, CASE WHEN new THEN 'R1' WHEN c_status = 'broken' THEN 'R2' WHEN c_status = 'degraded' THEN 'R3' ELSE 'R4' END AS rule_id FROM (
      SELECT *, c_status = 'broken' AND a_status <> 'broken' AND b_status <> 'broken' AS new FROM (SELECT merge_id, claim_id, max(status) FILTER ("view" = 'branch_a') AS a_status, max(status) FILTER ("view" = 'branch_b') AS b_status, max(status) FILTER ("view" = 'combined') AS c_status FROM surrogate GROUP BY ALL))""",
    "q69_claim_records": 'SELECT merge_id, claim_id, "view", n_regions, status FROM surrogate',
    "q70_api_response": f"""SELECT i.merge_id, o.overall_interaction <> 'none' AS conflict_detected, CASE o.overall_interaction {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.SUMMARIES.items())} END AS summary, s.n AS n_slices, i.claim_id, {oracle._ws("b.text")} AS claim, e.base_evidence,
      {", ".join(map(_effect, ("branch_a", "branch_b", "combined")))}, i.interaction, i.rule_id AS deterministic_rule FROM interactions i JOIN overall o USING (merge_id) JOIN (SELECT merge_id, count(*) AS n FROM slices GROUP BY ALL) s USING (merge_id) JOIN claims c ON c.merge_id = i.merge_id AND c.claim_id = i.claim_id
      JOIN base b ON b.merge_id = c.merge_id AND b.base_index = c.base_index JOIN (SELECT merge_id, claim_id, string_agg(kind || '@' || round("start" * 1000)::BIGINT, ',' ORDER BY kind = 'equivalent', "start", "end") AS base_evidence FROM regions GROUP BY ALL) e ON e.merge_id = i.merge_id AND e.claim_id = i.claim_id {_VIEW_JOINS}""",
    "q71_combined_timeline": f"""SELECT s.merge_id, s.base_index, round(b."start", 6) AS "start", round(b."end", 6) AS "end", verdict, combined_text AS text, CASE WHEN x.names IS NOT NULL THEN 'unanchored insert(s) at BASE position ' || id || ': ' || x.names
      WHEN ka = 'delete' AND kb = 'delete' THEN 'both branches deleted this BASE position (' || id || ')' WHEN ka = 'unchanged' AND kb = 'unchanged' THEN 'both branches left this BASE position unchanged (' || id || ')'
      WHEN ka = kb THEN 'both branches ' || da || ' this BASE position (' || id || ')' || CASE WHEN verdict = 'unresolved' THEN ' with DIFFERENT text; no deterministic winner' ELSE ' with identical text' END
      WHEN kb = 'unchanged' THEN 'branch_a ' || da || '; branch_b left unchanged (' || id || '); ' || CASE ka WHEN 'delete' THEN 'delete' WHEN 'replace' THEN 'A''s replacement' ELSE 'trim' END || ' wins'
      WHEN ka = 'unchanged' THEN 'branch_a left unchanged; branch_b ' || db || ' (' || id || '); ' || CASE kb WHEN 'delete' THEN 'delete' WHEN 'replace' THEN 'B''s replacement' ELSE 'B''s trim' END || ' wins'
      ELSE 'incompatible same-base dual edits (' || id || '): branch_a=' || ka || ', branch_b=' || kb || '; no deterministic winner' END AS reason
      FROM (SELECT *, {_ID} AS id, CASE ka WHEN 'delete' THEN 'deleted' WHEN 'replace' THEN 'replaced' WHEN 'trim' THEN 'trimmed' END AS da, CASE kb WHEN 'delete' THEN 'deleted' WHEN 'replace' THEN 'replaced' WHEN 'trim' THEN 'trimmed' END AS db FROM slices) s
      JOIN base b ON b.merge_id = s.merge_id AND b.base_index = s.base_index LEFT JOIN (SELECT merge_id, anchor, string_agg(branch || '@' || branch_index, ', ' ORDER BY branch, branch_index) AS names FROM attached GROUP BY ALL) x ON x.merge_id = s.merge_id AND x.anchor = s.base_index""",
    "q72_process_video": f""", fr AS (SELECT user_id AS video_id, event_id AS frame, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS ts, (max(epoch_us(ts)) OVER (PARTITION BY user_id) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS duration, "value" AS delta, event_type FROM events),
      isl AS (SELECT *, sum(jump) OVER (PARTITION BY video_id ORDER BY ts, frame ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY ts, frame) > 1 AND delta > 27.0 THEN 1 ELSE 0 END AS jump FROM fr)),
      sh AS (SELECT video_id, island AS sequence_index, "start", coalesce(lead("start") OVER (PARTITION BY video_id ORDER BY island), duration) AS "end" FROM (SELECT video_id, island, CASE WHEN island = 0 THEN 0.0::DOUBLE ELSE min(ts) END AS "start", any_value(duration) AS duration FROM isl WHERE duration > 0 GROUP BY video_id, island)),
      kf AS (SELECT s.video_id, s.sequence_index, arg_max(f.frame, (f.ts, f.frame)) AS keyframe FROM sh s JOIN fr f ON f.video_id = s.video_id AND f.ts <= (s."start" + s."end") / 2 WHERE s."end" > s."start" GROUP BY ALL),
      tr AS (SELECT video_id, sequence_index, trim(string_agg(event_type, ' ' ORDER BY frame)) AS transcript, count(*) AS n_segments FROM (SELECT *, rank() OVER (PARTITION BY video_id, frame ORDER BY overlap DESC) AS r FROM (SELECT f.video_id, f.frame, f.event_type, s.sequence_index, least(f.ts + 3600.0::DOUBLE, s."end") - greatest(f.ts, s."start") AS overlap
        FROM fr f JOIN sh s ON s.video_id = f.video_id AND f.ts + 3600.0::DOUBLE > s."start" AND f.ts < s."end") WHERE overlap > 0) WHERE r = 1 GROUP BY ALL)
      SELECT s.video_id, s.sequence_index, {_CUT("s.sequence_index")} AS shot_id, round(s."start", 6) AS "start", round(s."end", 6) AS "end", keyframe, coalesce(transcript, '') AS transcript, coalesce(n_segments, 0) AS n_segments FROM sh s LEFT JOIN kf USING (video_id, sequence_index) LEFT JOIN tr USING (video_id, sequence_index)""",
    "q73_transcript_cache": f"""SELECT video_id::VARCHAR AS fingerprint, bool_and(h > 1) AS hit, CASE WHEN bool_and(h > 1) THEN count(*) END AS n, CASE WHEN bool_and(h > 1) THEN string_agg(text, ' ' ORDER BY greatest("start", 0.0::DOUBLE), "end", text) END AS text FROM (SELECT *, {_D("video_id", "seg_no", "'cache'")} % 50 AS h FROM segs) GROUP BY video_id""",
    "q74_representation_cache": f"""SELECT DISTINCT merge_id::VARCHAR AS video_id FROM base WHERE {_D("merge_id", "'torn'")} % 3 = 0""",
    "q75_content_hash": "SELECT doc_id, substr(sha256(strlen(coalesce(text, ''))::VARCHAR || coalesce(text, '')), 1, 16) AS content_hash, substr(sha256(coalesce(text, '')), 1, 16) AS file_hash FROM documents",
    "q76_probe_json": """SELECT p_partkey AS video_id, CASE WHEN ok THEN p_size + 0.5::DOUBLE END AS duration_seconds, CASE WHEN ok THEN p_size * 8 END AS width, CASE WHEN ok THEN p_size * 6 END AS height, CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN p_partkey % 3 > 0 AND p_partkey % 60 > 0 THEN round((p_partkey % 60)::DOUBLE / (p_partkey % 3), 6) ELSE 25.0::DOUBLE END AS fps,
      CASE WHEN ok THEN 'h264' END AS codec, coalesce(ok AND p_partkey % 2 = 0, false) AS audio_present, CASE WHEN ok AND p_partkey % 2 = 0 THEN 'aac' END AS audio_codec, CASE WHEN ok THEN p_partkey END AS bit_rate FROM (SELECT *, p_partkey % 7 <> 0 AS ok FROM part)""",
    "q77_frame_statistics": f""", px AS (SELECT frame, {", ".join(f"least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor(e[((i + {by}) % len(e) + 1)] * 256.0::DOUBLE + 128.0::DOUBLE))) AS {c}" for c, by in zip("rgb", (0, 21, 42)))} FROM (SELECT vec_id AS frame, embedding::DOUBLE[] AS e, unnest(range(len(embedding))) AS i FROM embeddings))
      SELECT frame, {", ".join(f"round(avg({c}) / 255.0::DOUBLE, 6) AS {c}" for c in "rgb")}, concat_ws(',', {", ".join(f"round(count(*) FILTER (floor({c} / 64) = {b}) / count(*)::DOUBLE * 64)::BIGINT" for c in "rgb" for b in range(4))}) AS hist FROM px GROUP BY frame""",
    "q78_run_scores": "SELECT fixture, run, a_status = a_expected AS a_correct, b_status = b_expected AS b_correct, c_status = c_expected AS c_correct, interaction = expected AS interaction_correct, a_status = a_expected AND b_status = b_expected AND c_status = c_expected AND interaction = expected AS all_correct FROM runs",
    "q79_claim_modal": f"""SELECT merge_id, claim_id, "view", arg_max(status, n * 1000 - first) AS modal, count(*) AS variance, sum(n)::BIGINT AS n_runs FROM (SELECT merge_id, claim_id, "view", status, count(*) AS n, min(run) AS first FROM (
      SELECT merge_id, claim_id, "view", run, ['preserved', 'degraded', 'broken', ''][{_D("merge_id", "claim_id", '"view"', "run")} % 4 + 1] AS status FROM verdicts, (SELECT unnest(range(4)) AS run)) WHERE status <> '' GROUP BY ALL) GROUP BY ALL""",
    "q80_spike_findings": f"{_SPIKE} SELECT id, finding FROM finds",
    "q81_spike_decision": f"""{_SPIKE}, g AS (SELECT count(*) FILTER (label = want) AS combined_correct, count(*) AS combined_total, count(*) FILTER (label IS NOT NULL AND a = ae) + count(*) FILTER (label IS NOT NULL AND b = be) AS branch_correct, 2 * count(*) FILTER (label IS NOT NULL) AS branch_total FROM spike),
      w AS (SELECT *, (SELECT count(*) FROM finds WHERE finding = 'canonical_ok') AS canonical_ok, (SELECT count(*) FROM finds WHERE finding = 'safe_control_ok') AS safe_controls_ok FROM g),
      s AS (SELECT *, concat_ws('; ', CASE WHEN combined_correct < 7 THEN 'combined accuracy ' || combined_correct || '/' || combined_total || ' < required 7/' || combined_total END, CASE WHEN branch_correct < 14 THEN 'per-branch safety accuracy ' || branch_correct || '/' || branch_total || ' < required 14/' || branch_total END,
        CASE WHEN canonical_ok < 3 THEN 'canonical axis satisfied for ' || canonical_ok || '/3 conflict fixtures' END, CASE WHEN safe_controls_ok < 2 THEN 'original safe controls correctly classified: ' || safe_controls_ok || '/2' END) AS reasons FROM w)
      SELECT combined_correct, combined_total, branch_correct, branch_total, canonical_ok, safe_controls_ok, reasons, CASE WHEN reasons = '' THEN 'GO' ELSE 'INVESTIGATE' END AS decision FROM s""",
    "q82_spike_report": f"{_SPIKE} SELECT id, '| `' || id || '` | ' || want || ' | ' || coalesce(label, 'error') || ' | ' || {_SIDES['a']} || ' | ' || {_SIDES['b']} || ' |' AS line FROM spike",
    "q83_acceptance_findings": """SELECT merge_id, branch, step, operation, round(confidence, 6) AS confidence, finding FROM (SELECT *, unnest(CASE WHEN confidence < 0.5 THEN ['low_confidence'] ELSE [] END || CASE WHEN operation = 'uncertain' THEN ['uncertain'] ELSE [] END) AS finding FROM matches)""",
    "q84_disqualify_reasons": """SELECT fixture, branch, NULL::VARCHAR AS category, NULL::BIGINT AS shots, branch || printf(': min per-shot similarity %.2f < soft floor 0.50 (catastrophic transcript loss)', round(min_similarity, 2)) AS reason FROM videos WHERE min_similarity < 0.5
      UNION ALL SELECT fixture, branch, category, n, branch || ': missing ' || category || ' markers (' || n || ' shots) — semantic integrity broken' FROM (SELECT fixture, branch, category, count(DISTINCT shot_no) AS n FROM missing GROUP BY ALL)""",
    "q85_soft_warnings": f"""SELECT fixture, branch, shot_no, branch || ' ' || {_CUT("shot_no")} || printf(': similarity %.2f in [0.50, 0.75) — soft warning, lexical noise but no semantic-marker loss', round(similarity, 2)) AS warning FROM gate_judged WHERE similarity >= 0.5 AND similarity < 0.75""",
    "q86_context_payload": f""", marked AS ({_LINE}), ids AS (SELECT *, CASE WHEN base_index IS NULL THEN NULL ELSE {_CUT("base_index")} END AS bid, CASE WHEN branch_index IS NULL THEN NULL ELSE {_CUT("branch_index")} END AS rid FROM matches),
      body AS (SELECT merge_id, unnest([{", ".join(map(str, range(6)))}]) AS section, -1 AS pos, unnest([{", ".join(map(_head, range(6)))}]) AS line FROM (SELECT DISTINCT merge_id FROM base)
        UNION ALL SELECT merge_id, 0, base_index, '  ' || {_ID} || ' [' || {_C.format(x='"start"')} || '–' || {_C.format(x='"end"')} || ']  ' || coalesce(nullif({oracle._ws("text")}, ''), '(no transcript)') FROM base
        UNION ALL SELECT merge_id, CASE branch WHEN 'branch_a' THEN 1 ELSE 2 END, step, '  ' || CASE branch WHEN 'branch_a' THEN 'BRANCH A ' ELSE 'BRANCH B ' END || rpad(operation, 9, ' ') || '  base=' || rpad(coalesce(bid, '—'), 9, ' ') || '  branch=' || rpad(coalesce(rid, '—'), 9, ' ') || printf('  conf=%.2f', round(confidence, 2))
          || coalesce(printf('  visual=%.2f', round(visual, 2)), '  visual=None') || coalesce(printf('  transcript=%.2f', round(transcript, 2)), '  transcript=None') FROM ids
        UNION ALL SELECT merge_id, CASE branch WHEN 'branch_a' THEN 3 ELSE 4 END, base_index, '  ' || line FROM marked
        UNION ALL SELECT a.merge_id, 5, a.step * n.n + b.step + 1, printf('  Pair %02d', a.step * n.n + b.step + 1) || ': A.' || a.operation || '@' || coalesce(a.bid, '?') || '  ×  B.' || b.operation || '@' || coalesce(b.bid, '?') FROM ids a JOIN ids b ON b.merge_id = a.merge_id AND a.branch = 'branch_a' AND b.branch = 'branch_b'
          JOIN (SELECT merge_id, count(*) AS n FROM matches WHERE branch = 'branch_b' GROUP BY ALL) n ON n.merge_id = a.merge_id)
      SELECT merge_id, string_agg(line, chr(10) ORDER BY section, pos) AS payload FROM body GROUP BY ALL""",
    "q87_forensic_record": """SELECT o.merge_id, coalesce(c.n, 0) AS n_claims, overall_interaction, ['preserved', 'degraded', 'broken'][coalesce(severity, 0) + 1] AS overall_impact, coalesce(calls, 0) AS evaluations, explanation_calls AS explanations, coalesce(l.n, 0) AS n_lines, coalesce(e.n, 0) AS n_edits
      FROM overall o LEFT JOIN seen_verdicts s USING (merge_id) LEFT JOIN (SELECT merge_id, count(*) AS n FROM interactions GROUP BY ALL) c USING (merge_id) LEFT JOIN (SELECT merge_id, count(*) AS n FROM views WHERE trim(text) <> '' GROUP BY ALL) l USING (merge_id)
      LEFT JOIN (SELECT merge_id, count(*) AS n FROM matches WHERE base_index IS NOT NULL AND operation IN ('delete', 'replace', 'trim') GROUP BY ALL) e USING (merge_id)""",
}

ORACLE_SQL = {name: oracle.STEPS + select for name, select in SELECTS.items()}
