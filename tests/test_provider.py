"""Provider rounds with a scripted function against a plain loop."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tributary import config
from tributary.operators import provider, validate
from tributary.operators.provider import Reply

GOOD = json.dumps({"claim_id": "wrong", "branch": "branch_a", "status": "broken", "rationale": "r"})
BAD = json.dumps({"claim_id": "x", "branch": "nowhere", "status": "broken", "rationale": "r"})
#: What the function answers at each call, by request.
SCRIPT = {
    "sound": [Reply(200, GOOD)],
    "fenced": [Reply(200, f"```json\n{GOOD}\n```")],
    "busy": [Reply(503, "busy"), Reply(429, ""), Reply(200, GOOD)],
    "asked": [Reply(429, "", "0.2"), Reply(200, GOOD)],
    "never": [Reply(503, "x")] * 9,
    "denied": [Reply(401, "invalid api key")],
    "overload": [Reply(500, "upstream overloaded"), Reply(200, GOOD)],
    "locked": [Reply(500, "overloaded, 401 unauthorized")],
    "mended": [Reply(200, BAD), Reply(200, GOOD)],
    "hopeless": [Reply(200, BAD), Reply(200, "no json")],
    "text": [Reply(200, "[1]"), Reply(502, ""), Reply(200, GOOD)],
    "cut": [Reply(None, None, None, "ConnectError"), Reply(200, GOOD)],
    "boom": ["ValueError"],
    "late": [Reply(200, BAD), *[Reply(504, "")] * 9],
    "empty": [Reply(200, None), Reply(200, "")],
}


def scripted(folder):
    def call(payload):
        name = payload.split("\n")[0]
        path = os.path.join(folder, name)
        with open(path, "a") as f:
            f.write("x" if not payload.endswith("\n\n---\n\nmend it") else "r")
        step = SCRIPT[name][min(os.path.getsize(path), len(SCRIPT[name])) - 1]
        if isinstance(step, str):
            raise ValueError(name)
        return step

    return call


def by_hand():
    """(body or None, reason or None, [(phase, attempt, wait without jitter)]) of each request."""
    out = {}
    for name, script in SCRIPT.items():
        left, trail, verdict = list(script), [], None
        for phase in (0, 1):
            for attempt in range(5):
                reply = left.pop(0) if len(left) > 1 else left[0]
                if isinstance(reply, str):
                    reply = Reply(None, None, None, reply)
                body = (reply.body or "").lower()
                busy = any(t in body for t in config.RETRY_BODY_TOKENS) and not any(t in body for t in config.AUTH_BODY_TOKENS)
                again = reply.error_class in config.TRANSPORT_ERRORS if reply.error_class else reply.status in config.RETRY_STATUSES or busy
                again = again and attempt < 4
                trail.append((phase, attempt, (float(reply.retry_after) if reply.retry_after else config.RETRY_DELAYS[attempt]) if again else None))
                if not again:
                    break
            if reply.error_class:
                verdict = f"error {reply.error_class}"
                break
            if reply.status != 200:
                verdict = f"status {reply.status}"
                break
            try:
                record = json.loads((reply.body or "").replace("```json", "").replace("```", ""))
                verdict = None if isinstance(record, dict) and record["branch"] == "branch_a" else "refused"
            except ValueError:
                verdict = "refused"
            if verdict is None:
                break
        out[name] = (verdict, trail)
    return out


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    requests = spark.createDataFrame([(n, n, f"C-{n}", 1) for n in SCRIPT], "request_id string, payload string, claim string, due_at int").repartition(3)
    waits = tmp_path_factory.mktemp("calls")
    return provider.ask(requests, scripted(str(waits)), validate.survival_problem, "mend it", {"claim_id": "claim"}, sleep=lambda s: None), str(waits)


def test_attempts_waits_and_results_equal_a_loop(outcome):
    (results, dead, log), folder = outcome
    want = by_hand()
    got, lost = {r.request_id: json.loads(r.body) for r in results.collect()}, {r.request_id: r for r in dead.collect()}
    assert set(got) == {n for n, w in want.items() if w[0] is None} and set(lost) == set(SCRIPT) - set(got)
    assert all(body["claim_id"] == f"C-{n}" and set(body) == {"claim_id", "branch", "status", "rationale"} for n, body in got.items())
    for n, r in lost.items():
        assert r.reason.startswith(want[n][0]) and r.attempts == want[n][1][-1][1] + 1 and r.phase == want[n][1][-1][0]
    for n, (_, trail) in want.items():
        mine = sorted((r.phase, r.attempt, r.wait) for r in log.where(F.col("request_id") == n).collect())
        assert [m[:2] for m in mine] == [t[:2] for t in trail]
        assert all((m[2] is None) == (t[2] is None) and (m[2] is None or 0 <= m[2] - t[2] < config.RETRY_JITTER) for m, t in zip(mine, trail))
        # Every attempt was one call, and the repair was asked for in its own words.
        assert open(os.path.join(folder, n)).read() == "".join("xr"[t[0]] for t in trail)


def test_requests_wait_until_they_are_due(outcome):
    (_, _, log), _ = outcome
    for n in ("busy", "asked"):
        rows = sorted(log.where(F.col("request_id") == n).collect(), key=lambda r: r.attempt)
        assert rows[0].due_at is None
        assert all(abs(b.due_at - a.replied_at - a.wait) < 1e-6 for a, b in zip(rows, rows[1:]))


def test_counters_and_empty_requests(spark, outcome):
    (_, _, log), _ = outcome
    trails = [t for _, w in by_hand().items() for t in w[1]]
    row = provider.usage(log).first()
    assert (row.calls, row.retries) == (len(trails), sum(t[2] is not None for t in trails))
    none = provider.ask(spark.createDataFrame([], "request_id string, payload string"), scripted("/nowhere"), validate.survival_problem, "mend it")
    assert none.results.count() == none.dead.count() == none.log.count() == 0


def test_forced_fields(spark):
    rows = spark.createDataFrame([('{"a":1,"claim_id":[2]}', 'q"\\'), ("{}", "é"), ("[]", "x"), ("oops", "x"), (None, "x")], "body string, claim string")
    got = [r.b and json.loads(r.b) for r in rows.select(provider.force(F.col("body"), claim_id=F.col("claim")).alias("b")).collect()]
    assert got == [{"a": 1, "claim_id": 'q"\\'}, {"claim_id": "é"}, None, None, None]
