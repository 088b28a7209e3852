"""Registered queries over uploads, incremental caches, typed records and provider replies; with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tributary import config
from tributary.operators import evaluate, frames, gate, provider, render, validate
from tributary.operators.ordered import scanned
from tributary.plans import oracle
from tributary.plans.queries import _flow, gate_lines, r6, segments
from tributary.sources import derived, files, uploads

UPLOAD_LIMIT = 8_000


def q88(f):
    """Documents stored as one file each and scanned as uploads: sizes, refusals, hashes by range reads."""
    path = files.work_folder(f.spark)
    name = F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    uploads.store(f.table("documents").select(name.alias("name"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content")), path)
    rows = uploads.uploads(f.spark, path, UPLOAD_LIMIT, suffix=".txt", whole=True)
    return rows.select(F.regexp_extract("path", "doc_id=(-?[0-9]*)\\.txt$", 1).try_cast("long").alias("doc_id"), "length", "reject", "content_hash", "file_hash", "bytes_read")


def q89(f):
    """Transcripts cached, a third of the videos cached again with other texts, and all read back."""
    rows = segments(f).select(F.col("video_id").cast("string").alias("fingerprint"), F.greatest("start", F.lit(0.0)).alias("start"), "end", "text", F.lit(0.5).alias("confidence"))
    path = files.work_folder(f.spark)
    files.write_transcripts(rows, path)
    again = rows.where(derived.draw(F.col("fingerprint"), F.lit("again")) % 3 == 0)
    files.write_transcripts(again.withColumn("text", F.concat(F.lit("again "), "text")), path)
    back = files.read_transcripts(f.spark, path)
    return back.select("fingerprint", F.size("segments").cast("long").alias("n"), F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("text"))


def q90(f):
    """Claim records with the right keys and, by hash, a wrong type or text after the record, judged."""
    rows = f.claims.join(f.base.select("merge_id", "base_index", "text", "start", "end"), ["merge_id", "base_index"])
    d = derived.draw(F.col("merge_id"), F.col("claim_id"), F.lit("type")) % 11
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), '(?s)^\\{"t":(.*)\\}$', 1)
    meaning = F.when(d == 0, "5").when(d == 1, '{"a":1}').otherwise(quoted)
    span = F.concat(F.lit('[{"start":'), F.col("start").cast("string"), F.lit(',"end":'), F.col("end").cast("string"), F.lit(',"description":'), F.when(d == 3, "7").otherwise('"said"'), F.lit("}]"))
    raw = F.concat(
        F.lit('{"claim_id":'), F.when(d == 6, "1").otherwise(F.concat(F.lit('"'), "claim_id", F.lit('"'))), F.lit(',"meaning":'), meaning, F.lit(f',"claim_type":"{config.CLAIM_TYPES[0]}","importance":'),
        F.when(d == 5, '["high"]').otherwise('"high"'), F.lit(',"evidence_regions":'), F.when(d == 2, "null").otherwise(span), F.lit(',"equivalents":'), F.when(d == 4, "null").otherwise("[]"), F.when(d == 7, "} {}").otherwise("}"),
    )
    return rows.select("merge_id", "claim_id", validate.claim_problem(raw).alias("problem"))


#: Replies of a provider as they may come: status, body, Retry-After, class of a transport error.
REPLIES = [
    (200, "ok", None, None), (503, "busy", None, None), (429, "", "7", None), (500, "Upstream Overloaded", "0.5", None), (500, "overloaded, 401 Unauthorized", None, None), (400, "no such model", None, None),
    (502, "bad gateway", "-1", None), (504, "", "soon", None), (401, "invalid api key", None, None), (418, "rate limit exceeded", None, None), (None, None, None, "ConnectError"), (None, None, None, "ValueError"),
]


def q91(f):
    """Whether and when each attempt of the event log is tried again: a user's events are its attempts, their replies a table's rows."""
    replies = F.broadcast(f.spark.createDataFrame([(i, *r) for i, r in enumerate(REPLIES)], "reply int, status int, body string, retry_after string, error_class string"))
    log = f.table("events").select("event_id", "user_id", "ts", (F.col("event_id") % len(REPLIES)).cast("int").alias("reply"))
    rows = scanned(log, ["user_id"], ["ts", "event_id"], sums={"attempt": F.lit(1)}).join(replies, "reply")
    again = F.coalesce(evaluate.retryable(F.col("status"), F.col("body"), F.col("error_class")), F.lit(False))
    wait = evaluate.backoff(F.col("attempt").cast("int"), evaluate.retry_after_seconds(F.col("retry_after"), F.col("ts").cast("timestamp")))
    return rows.select("event_id", F.col("attempt").cast("long").alias("attempt"), again.alias("retryable"), r6(F.when(again, wait)).alias("wait"))


def scripted_reply(payload: str) -> provider.Reply:
    """A stand-in provider: the payload's number decides what comes back; a repaired request may fare better."""
    record, _, repair = payload.partition("\n")
    given = json.loads(record)
    kind, sound = given["draw"] % 8, {"claim_id": "?", "branch": given["view"], "status": "broken", "rationale": "told"}
    if kind == 0:
        return provider.Reply(503, "busy")
    if kind == 1:
        return provider.Reply(401, "invalid api key")
    if kind == 2 and not repair or kind == 3:
        return provider.Reply(200, json.dumps({**sound, "status": "lost"}))
    if kind == 4:
        raise ValueError("no connection")
    return provider.Reply(200, json.dumps(sound))


def q92(f):
    """Every claim in every view asked of a scripted provider: retries, one repair, forced ids, dead letters, calls made."""
    request = F.concat_ws("/", "merge_id", "claim_id", "view")
    payload = F.to_json(F.struct(derived.draw(F.col("merge_id"), F.col("claim_id"), F.col("view"), F.lit("ask")).alias("draw"), "view"))
    asked = f.verdicts.select(request.alias("request_id"), payload.alias("payload"), "claim_id", "view")
    out = provider.ask(asked, scripted_reply, validate.survival_problem, "Answer in the form asked for.", {"claim_id": "claim_id", "branch": "view"}, sleep=lambda s: None)
    calls = out.log.groupBy("request_id").agg(F.count("*").alias("calls"))
    told = out.results.select("request_id", F.get_json_object("body", "$.claim_id").alias("claim_id"), F.get_json_object("body", "$.status").alias("status"))
    return calls.join(told, "request_id", "left").join(out.dead.select("request_id", "reason"), "request_id", "left").select("request_id", "calls", "claim_id", "status", "reason")


def q93(f):
    """Hash, mean colour and histogram of frames of 32 x 32 pixels whose colours come from an embedding's components."""
    e = f.table("embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.abs(x) * 1000)).alias("e"))

    def byte(i, c: int):
        mixed = F.element_at("e", (i % 64 + 1).cast("int")) + i * i * 31 + i * 17 * (F.col("vec_id") % 13 + 1) + 97 * c
        return F.lpad(F.hex(mixed % 256), 2, "0")

    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long")), lambda i: F.concat(byte(i, 0), byte(i, 1), byte(i, 2))), ""))
    rows = frames.frame_features(e.select(F.col("vec_id").alias("frame"), F.lit(32).alias("width"), F.lit(32).alias("height"), pixels.alias("pixels")))
    return rows.select("frame", "hash", *[r6(F.col("rgb")[i]).alias(c) for i, c in enumerate("rgb")], F.array_join(F.transform("hist", lambda h: F.round(h * 3072).cast("long").cast("string")), ",").alias("hist"))


def q94(f):
    """Similarity of each branch shot to BASE's line of the same number."""
    shots = f.branch.select(F.col("merge_id").alias("fixture"), "branch", F.col("branch_index").alias("shot_no"), "text")
    script = f.base.select(F.col("merge_id").alias("fixture"), F.explode(F.array(*map(F.lit, derived.BRANCHES))).alias("branch"), F.col("base_index").alias("line_no"), "text")
    return gate.judged(gate.by_ordinal(shots, script)).select("fixture", "branch", "shot_no", r6("similarity").alias("similarity"))


def q95(f):
    return gate.category_sums(gate.missing_markers(gate_lines(f)))


def q96(f):
    return evaluate.false_edits(f.matches, f.script)


def q97(f):
    """Requests to explain the claims that the two edits destroy together."""
    said = f.claims.join(f.base.select("merge_id", "base_index", F.col("text").alias("meaning")), ["merge_id", "base_index"]).select("merge_id", "claim_id", "meaning")
    return render.explanation_payload(f.interactions.join(said, ["merge_id", "claim_id"]).withColumn("derivation_reason", F.col("rule_id")))


BUILDERS = {"q88_upload_scan": q88, "q89_cache_rewrite": q89, "q90_claim_types": q90, "q91_reply_policy": q91, "q92_provider_rounds": q92, "q93_frame_features": q93, "q94_ordinal_gate": q94, "q95_category_sums": q95, "q96_false_edits": q96, "q97_explanation_payload": q97}

QUERIES = {name: _flow(build) for name, build in BUILDERS.items()}

_D = oracle._draw
_SAID = "string_agg(text, ' ' ORDER BY greatest(\"start\", 0.0::DOUBLE), \"end\", text)"


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


_REPLIES = ", ".join("(" + ", ".join(map(_value, (i, *r))) + ")" for i, r in enumerate(REPLIES))
_HAS = lambda names: " OR ".join(f"contains(lower(coalesce(body, '')), '{n}')" for n in names)
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)

#: Whole-number weights that reduce a line of 32 samples to one.
_ONE = "[" + ", ".join(map(str, frames.weights(32, 1)[0].tolist())) + "]"


def _reduced(table: str, keys: str, at: str, values: list[str]) -> str:
    sums = ", ".join(f"least(255, greatest(0, (sum({_ONE}[{at} + 1] * {v})::BIGINT + {1 << 21}) >> 22)) AS {v}" for v in values)
    return f"SELECT {keys}, {sums} FROM {table} GROUP BY {keys}"


_FRAMES = f"""WITH px AS (SELECT vec_id AS frame, i // 32 AS x, i % 32 AS y, {", ".join(f"(m + {97 * c}) % 256 AS {n}" for c, n in enumerate("rgb"))}
    FROM (SELECT vec_id, i, floor(abs(embedding[(i % 64) + 1]::DOUBLE) * 1000)::BIGINT + i * i * 31 + i * 17 * (vec_id % 13 + 1) AS m FROM embeddings, (SELECT unnest(range(1024)) AS i))),
  gray AS (SELECT frame, x, y, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS v FROM px),
  basis AS (SELECT u, x, cos(pi() * (2 * u + 1) * x / 64) * sqrt(2.0 / 32) * CASE u WHEN 0 THEN 1 / sqrt(2.0) ELSE 1 END AS w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS x)),
  half AS (SELECT frame, u, y, sum(w * v) AS v FROM gray JOIN basis USING (x) GROUP BY ALL),
  low AS (SELECT frame, h.u, b.u AS k, CASE WHEN h.u = 0 AND b.u = 0 THEN 0 ELSE sum(w * v) END AS v FROM half h JOIN basis b ON b.x = h.y GROUP BY frame, h.u, b.u),
  bits AS (SELECT frame, string_agg(CASE WHEN v > middle THEN '1' ELSE '0' END, '' ORDER BY u, k)[1:55] AS bits FROM low JOIN (SELECT frame, median(v) AS middle FROM low GROUP BY frame) USING (frame) GROUP BY frame),
  lines AS ({_reduced("px", "frame, x", "y", ["r", "g", "b"])}), dots AS ({_reduced("lines", "frame", "x", ["r", "g", "b"])}),
  code AS (SELECT frame, {" || ".join(f"substr(format('{{:08b}}', {c}::BIGINT), 1, 3)" for c in "rgb")} || bits AS bits FROM bits JOIN dots USING (frame)),
  means AS (SELECT frame, {", ".join(f"round(avg({c} / 255.0::DOUBLE), 6) AS {c}" for c in "rgb")}, {" || ',' || ".join(f"count(*) FILTER ({c} // 64 = {b})" for c in "rgb" for b in range(4))} AS hist FROM px GROUP BY frame)
"""

SELECTS = {
    "q88_upload_scan": f"""SELECT doc_id, strlen(body)::BIGINT AS length, CASE WHEN strlen(body) > {UPLOAD_LIMIT} THEN 'upload too large' END AS reject,
      CASE WHEN strlen(body) <= {UPLOAD_LIMIT} THEN substr(sha256(strlen(body)::VARCHAR || body), 1, 16) END AS content_hash, CASE WHEN strlen(body) <= {UPLOAD_LIMIT} THEN substr(sha256(body), 1, 16) END AS file_hash,
      CASE WHEN strlen(body) <= {UPLOAD_LIMIT} THEN 2 * strlen(body) ELSE 0 END::BIGINT AS bytes_read
      FROM (SELECT doc_id, coalesce(text, '') || chr(10) AS body FROM documents)""",
    "q94_ordinal_gate": f"""SELECT fixture, branch, shot_no, round(CASE WHEN len(list_distinct(e || r)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(e, r))::DOUBLE / len(list_distinct(e || r)) END, 6) AS similarity FROM (
      SELECT fixture, branch, shot_no, list_distinct({oracle._gate_tokens("expected")}) AS e, list_distinct({oracle._gate_tokens("recognized")}) AS r FROM (
        SELECT r.merge_id AS fixture, r.branch, r.branch_index AS shot_no, coalesce(b.text, '') AS expected, r.text AS recognized FROM branch r LEFT JOIN base b ON b.merge_id = r.merge_id AND b.base_index = r.branch_index))""",
    "q97_explanation_payload": f"""SELECT i.merge_id, i.claim_id, {" || ".join(f"'{label}: ' || coalesce({column}, '') || chr(10)" for label, column in {**render.EXPLANATION_FIELDS, "claim_id": "i.claim_id", "claim_meaning": "b.text", "derivation_reason": "rule_id"}.items())} || chr(10) || '{render.EXPLANATION_REQUEST}' AS payload
      FROM interactions i JOIN claims c ON c.merge_id = i.merge_id AND c.claim_id = i.claim_id JOIN base b ON b.merge_id = c.merge_id AND b.base_index = c.base_index WHERE interaction <> 'none'""",
    "q95_category_sums": "SELECT fixture, category, count(*) AS shots FROM (SELECT DISTINCT fixture, branch, shot_no, category FROM missing) GROUP BY ALL",
    "q96_false_edits": """SELECT merge_id, branch, unchanged, CASE WHEN unchanged THEN coalesce(n, 0) END AS false_edits FROM (SELECT merge_id, branch, bool_and(edit = 'keep') AS unchanged FROM script GROUP BY ALL)
      LEFT JOIN (SELECT merge_id, branch, count(*) FILTER (operation IN ('delete', 'insert', 'replace')) AS n FROM matches GROUP BY ALL) USING (merge_id, branch)""",
    "q89_cache_rewrite": f"""SELECT fingerprint, count(*) AS n, {_SAID} AS text FROM (
      SELECT fingerprint, "start", "end", CASE WHEN {_D("fingerprint", "'again'")} % 3 = 0 THEN 'again ' || text ELSE text END AS text FROM (SELECT *, video_id::VARCHAR AS fingerprint FROM segs)) GROUP BY fingerprint""",
    "q90_claim_types": f"""SELECT merge_id, claim_id, CASE WHEN d = 7 THEN 'malformed' WHEN d = 6 THEN 'blank claim id' WHEN d IN (0, 1) OR text = '' THEN 'blank meaning' WHEN d = 5 THEN 'importance' WHEN d IN (2, 3) THEN 'evidence' WHEN d = 4 THEN 'equivalents' END AS problem
      FROM (SELECT c.merge_id, c.claim_id, b.text, {_D("c.merge_id", "c.claim_id", "'type'")} % 11 AS d FROM claims c JOIN base b USING (merge_id, base_index))""",
    "q91_reply_policy": f"""SELECT event_id, attempt, again AS retryable, CASE WHEN again AND attempt <= 4 THEN coalesce(CASE WHEN try_cast(retry_after AS DOUBLE) > 0 THEN try_cast(retry_after AS DOUBLE) END, [2.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE, 20.0::DOUBLE][attempt]) END AS wait
      FROM (SELECT *, CASE WHEN error_class IS NOT NULL THEN error_class IN ({_LIST(config.TRANSPORT_ERRORS)}) ELSE coalesce(status IN ({", ".join(map(str, config.RETRY_STATUSES))}), false) OR (({_HAS(config.RETRY_BODY_TOKENS)}) AND NOT ({_HAS(config.AUTH_BODY_TOKENS)})) END AS again
        FROM (SELECT event_id, event_id % {len(REPLIES)} AS reply, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events) JOIN (VALUES {_REPLIES}) AS t(reply, status, body, retry_after, error_class) USING (reply))""",
    "q92_provider_rounds": f"""SELECT merge_id || '/' || claim_id || '/' || "view" AS request_id, CASE k WHEN 0 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS calls, CASE WHEN k IN (2, 5, 6, 7) THEN claim_id END AS claim_id, CASE WHEN k IN (2, 5, 6, 7) THEN 'broken' END AS status,
      CASE k WHEN 0 THEN 'status 503' WHEN 1 THEN 'status 401' WHEN 3 THEN 'refused: status' WHEN 4 THEN 'error ValueError' END AS reason FROM (SELECT *, {_D("merge_id", "claim_id", '"view"', "'ask'")} % 8 AS k FROM verdicts)""",
}

ORACLE_SQL = {name: oracle.STEPS + select for name, select in SELECTS.items()}
_HEX = " || ".join(f"['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'][(bits[{4 * i + 1}]::INT * 8 + bits[{4 * i + 2}]::INT * 4 + bits[{4 * i + 3}]::INT * 2 + bits[{4 * i + 4}]::INT) + 1]" for i in range(16))
ORACLE_SQL["q93_frame_features"] = f"{_FRAMES} SELECT frame, {_HEX} AS hash, r, g, b, hist FROM code JOIN means USING (frame)"
