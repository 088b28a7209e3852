"""Calls to a provider of judgements as rounds of Spark jobs around a caller's function.

A round calls the function once for every request that is due and writes its
replies as a table, so a lost executor repeats the calls of its own tasks alone
and every attempt is on record.  Whether a reply is tried again, and after how
long, is decided by expressions over that table.  A task waits until each of its
requests is due, earliest first, so the waits of its requests overlap.  Rounds
are bounded: five attempts for a request as given and five for its repair.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import config
from tributary.functions import text as T
from tributary.operators.evaluate import backoff, retry_after_seconds, retryable
from tributary.sources.derived import draw
from tributary.sources.files import materialized

ATTEMPTS = len(config.RETRY_DELAYS) + 1


class Reply(NamedTuple):
    """What one call gives: a status with a body, or the class of a transport error."""

    status: int | None
    body: str | None = None
    retry_after: str | None = None
    error_class: str | None = None


class Outcome(NamedTuple):
    """``results`` (request_id, body), ``dead`` (request_id, reason, phase, attempts) and the ``log`` of all attempts."""

    results: DataFrame
    dead: DataFrame
    log: DataFrame


def force(body: Column, **values: Column) -> Column:
    """A JSON object's text with the given fields set, whatever it had there; null where there is no object."""
    fields = F.try_variant_get(F.try_parse_json(T.unfenced_json(body)), "$", "map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*values))
    given = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.to_variant_object(F.array(v)))])
    return F.to_json(F.map_concat(kept, F.transform_values(given, lambda k, v: F.try_variant_get(v, "$[0]", "variant"))))


def jitter(request_id: Column, phase: int, attempt: int) -> Column:
    """Up to ``config.RETRY_JITTER`` seconds, fixed by the request and its attempt."""
    return draw(request_id, F.lit(phase), F.lit(attempt), F.lit("jitter")) / float(1 << 28) * config.RETRY_JITTER


def _called(due: DataFrame, call: Callable[[str], Reply], sleep: Callable[[float], None] | None) -> DataFrame:
    """Each due request with its reply; an exception of ``call`` is a transport error of its class."""

    def run(batches):
        pause = sleep or time.sleep
        for batch in batches:
            replies = []
            for payload, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if at is not None and at > time.time():
                    pause(at - time.time())
                try:
                    reply = call(payload)
                except Exception as e:  # recorded, and tried again or not by its class
                    reply = Reply(None, None, None, type(e).__name__)
                replies.append((*reply, time.time()))
            columns = [pa.array([r[i] for r in replies], k) for i, k in enumerate((pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["request_id", "payload", "due_at", "status", "body", "retry_after", "error_class", "replied_at"])

    ordered = due.select("request_id", "payload", "due_at").sortWithinPartitions("due_at", "request_id")
    return ordered.mapInArrow(run, "request_id string, payload string, due_at double, status int, body string, retry_after string, error_class string, replied_at double")


def _phase(requests: DataFrame, call, phase: int, sleep) -> DataFrame:
    """The log of up to five attempts for each request: reply, whether it is tried again, and the wait before that."""
    due, log = requests.withColumn("due_at", F.lit(None).cast("double")), None
    for attempt in range(ATTEMPTS):
        again = F.coalesce(retryable(F.col("status"), F.col("body"), F.col("error_class")), F.lit(False)) if attempt < ATTEMPTS - 1 else F.lit(False)
        asked = retry_after_seconds(F.col("retry_after"), F.timestamp_seconds("replied_at"))
        wait = backoff(F.lit(attempt + 1), asked) + jitter(F.col("request_id"), phase, attempt)
        replies = _called(due, call, sleep).withColumns({"phase": F.lit(phase), "attempt": F.lit(attempt), "again": again, "wait": F.when(again, wait)})
        replies = materialized(replies)
        log = replies if log is None else log.unionAll(replies)
        due = replies.where("again").select("request_id", "payload", (F.col("replied_at") + F.col("wait")).alias("due_at"))
        if due.isEmpty():
            break
    return log


def ask(
    requests: DataFrame,
    call: Callable[[str], Reply],
    problem: Callable[[Column], Column],
    repair: str,
    forced: dict[str, str] | None = None,
    sleep: Callable[[float], None] | None = None,
) -> Outcome:
    """Ask ``call`` about every request (request_id, payload, ...).

    ``problem`` says why a body is refused (null: sound).  A refused reply is
    asked for once more with ``repair`` below its payload; what is refused
    again, or answered with no success, is a dead letter with its reason.
    ``forced`` maps fields of the body to columns of ``requests`` that they are
    set to before the body is judged.  Request ids must be unique and not null.
    """
    forced = forced or {}
    given = materialized(requests.withColumn("request_id", F.col("request_id").cast("string")))
    ids = given.select("request_id", *[F.col(c).alias(f"_f_{f}") for f, c in forced.items()])
    first = _phase(given.select("request_id", "payload"), call, 0, sleep)

    def judged(log: DataFrame) -> DataFrame:
        last = log.where(~F.col("again")).join(ids, "request_id")
        told = force(F.col("body"), **{f: F.col(f"_f_{f}") for f in forced}) if forced else F.col("body")
        ok = F.col("status").between(200, 299)
        last = last.withColumn("told", F.when(ok, told))
        refused = F.when(ok, F.coalesce(problem(F.col("told")), F.when(F.col("told").isNull(), "malformed")))
        failed = F.when(F.col("error_class").isNotNull(), F.concat(F.lit("error "), "error_class")).when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
        return materialized(last.withColumn("refused", refused).withColumn("failed", failed))

    one = judged(first)
    mend = one.where("refused is not null").select("request_id", F.concat("payload", F.lit("\n\n---\n\n" + repair)).alias("payload"))
    log, two = first, one.where("false")
    if not mend.isEmpty():
        second = _phase(mend, call, 1, sleep)
        log, two = first.unionAll(second), judged(second)
    sound = F.col("refused").isNull() & F.col("failed").isNull()
    results = one.where(sound).unionAll(two.where(sound)).select("request_id", F.col("told").alias("body"))
    lost = one.where("failed is not null").unionAll(two.where(~sound))
    dead = lost.select("request_id", F.coalesce("failed", F.concat(F.lit("refused: "), "refused")).alias("reason"), "phase", (F.col("attempt") + 1).alias("attempts"))
    return Outcome(results, dead, log)


def usage(log: DataFrame) -> DataFrame:
    """One row of counters over a log: calls, successes, retries, failures, 429 replies, busy 503 replies."""
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    return log.agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("successful_calls"), F.count_if("again").alias("retries"), F.count_if(~ok & ~F.col("again")).alias("provider_failures"),
        F.count_if(F.col("status") == 429).alias("http_429_count"), F.count_if(F.col("status") == 503).alias("upstream_503_count"),
    )
