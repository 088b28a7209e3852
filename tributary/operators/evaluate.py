"""Evaluation of repeated runs: modal verdicts, accuracies, gates, attempt windows, failures, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary import config
from tributary.operators.ordered import scanned
from tributary.sources.derived import draw


def modal(rows: DataFrame, keys: list[str], value: str, run: str) -> DataFrame:
    """Most frequent value of each key; the value seen first wins ties.  Nulls and blanks don't count."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(run).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value), F.count("*").alias("variance"), F.sum("n").alias("n_runs"))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of each value as sorted ``value=n`` text."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    pair = F.concat_ws("=", value, F.col("n").cast("string"))
    return counts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("distribution"))


def axis_accuracy(scored: DataFrame, axes: list[str]) -> DataFrame:
    """Share of rows correct on each axis and on all, with the 75 % gate (at least one)."""
    hit = [F.col(f"{a}_modal") == F.col(f"{a}_expected") for a in axes]
    every = hit[0]
    for h in hit[1:]:
        every = every & h
    counts = scored.agg(F.count("*").alias("n"), *[F.count_if(h).alias(a) for a, h in zip(axes, hit)], F.count_if(every).alias("all_axes"))
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("correct")) for a in [*axes, "all_axes"]]))
    need = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * 0.75).cast("long"))
    return counts.select("n", need.alias("needed"), rows.alias("r")).select("r.axis", "n", "r.correct", (F.col("r.correct") / F.col("n")).alias("accuracy"), (F.col("r.correct") >= F.col("needed")).alias("passed"))


def score_runs(runs: DataFrame, axes: list[str]) -> DataFrame:
    """Runs with ``<axis>_correct`` for each axis (``<axis>`` against ``<axis>_expected``) and ``all_correct``."""
    hits = {a: F.coalesce(F.col(a) == F.col(f"{a}_expected"), F.lit(False)) for a in axes}
    every = F.lit(True)
    for h in hits.values():
        every = every & h
    return runs.withColumns({**{f"{a}_correct": h for a, h in hits.items()}, "all_correct": every})


def spike_findings(rows: DataFrame) -> DataFrame:
    """(id, finding) of judged text fixtures, a row for each error and each canonical or control fixture that is right.

    ``rows`` has id, label, expected_label, a_safe, b_safe, their ``_expected``,
    and the marks ``canonical`` and ``control``; an unparsed row (null label)
    finds nothing.
    """
    label, wanted = F.col("label"), F.col("expected_label")
    found = {
        "false_positive": (label == "conflict") & (wanted == "safe"), "false_negative": (label == "safe") & (wanted == "conflict"),
        "canonical_ok": F.col("canonical") & F.col("a_safe") & F.col("b_safe") & (label == "conflict"), "safe_control_ok": F.col("control") & (label == "safe"),
    }
    for x in "ab":
        found[f"branch_{x}_false_negative"] = ~F.col(f"{x}_safe_expected") & F.col(f"{x}_safe")
        found[f"branch_{x}_false_positive"] = F.col(f"{x}_safe_expected") & ~F.col(f"{x}_safe")
    names = F.array_compact(F.array(*[F.when(hit, name) for name, hit in found.items()]))
    return rows.where(label.isNotNull()).select("id", F.explode(names).alias("finding"))


def spike_decision(rows: DataFrame, combined: int = 7, branch: int = 14, canonical: int = 3, controls: int = 2) -> DataFrame:
    """GO or INVESTIGATE with the reasons, from counts of right verdicts against what the gate requires."""
    gate = spike_gate(rows).select("combined_correct", "combined_total", "branch_correct", "branch_total")
    finds = spike_findings(rows).agg(F.count_if(F.col("finding") == "canonical_ok").alias("canonical_ok"), F.count_if(F.col("finding") == "safe_control_ok").alias("safe_controls_ok"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("combined_correct") < combined, F.format_string(f"combined accuracy %d/%d < required {combined}/%d", "combined_correct", "combined_total", "combined_total")),
            F.when(F.col("branch_correct") < branch, F.format_string(f"per-branch safety accuracy %d/%d < required {branch}/%d", "branch_correct", "branch_total", "branch_total")),
            F.when(F.col("canonical_ok") < canonical, F.format_string(f"canonical axis satisfied for %d/{canonical} conflict fixtures", "canonical_ok")),
            F.when(F.col("safe_controls_ok") < controls, F.format_string(f"original safe controls correctly classified: %d/{controls}", "safe_controls_ok")),
        )
    )
    both = gate.join(finds).withColumn("reasons", F.array_join(reasons, "; "))
    return both.withColumn("decision", F.when(F.col("reasons") == "", "GO").otherwise("INVESTIGATE"))


def report_rows(rows: DataFrame) -> DataFrame:
    """(id, line): each fixture as a row of the Markdown report's table."""

    def side(x: str) -> Column:
        wanted, got = F.col(f"{x}_safe_expected"), F.col(f"{x}_safe")
        mark = F.when(wanted.eqNullSafe(got), "OK").when(wanted, "FP").otherwise("FN")
        shown = lambda c: F.when(c, "True").when(~c, "False").otherwise("None")
        return F.concat(shown(wanted), F.lit("/"), shown(got), F.lit(" "), mark)

    line = F.concat(F.lit("| `"), F.col("id").cast("string"), F.lit("` | "), "expected_label", F.lit(" | "), F.coalesce("label", F.lit("error")), F.lit(" | "), side("a"), F.lit(" | "), side("b"), F.lit(" |"))
    return rows.select("id", line.alias("line"))


def acceptance_findings(rows: DataFrame, low: float = 0.5) -> DataFrame:
    """(merge_id, branch, step, finding): steps of low confidence and uncertain ones, one row each, as the acceptance report lists them."""
    names = F.array_compact(F.array(F.when(F.col("confidence") < low, "low_confidence"), F.when(F.col("operation") == "uncertain", "uncertain")))
    return rows.select("merge_id", "branch", "step", "operation", "confidence", F.explode(names).alias("finding"))


def confusion(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """Counts and ratios of a yes/no judgement; ratios are null where nothing was to be judged."""
    p, y = predicted, expected
    c = rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(fn, fn + tp).alias("fnr"),
    )


def spike_gate(rows: DataFrame) -> DataFrame:
    """Gate over text fixtures: combined and per-branch correct counts; unparsed rows count as wrong combined, not at all per branch."""
    c_ok = F.coalesce(F.col("label") == F.col("expected_label"), F.lit(False))
    parsed = F.col("label").isNotNull()
    a_ok, b_ok = F.col("a_safe") == F.col("a_safe_expected"), F.col("b_safe") == F.col("b_safe_expected")
    return rows.agg(
        F.count("*").alias("combined_total"), F.count_if(c_ok).alias("combined_correct"),
        (2 * F.count_if(parsed)).alias("branch_total"), (F.count_if(parsed & a_ok) + F.count_if(parsed & b_ok)).alias("branch_correct"),
        F.count_if(parsed & (F.col("label") == "conflict") & (F.col("expected_label") == "safe")).alias("false_positives"),
        F.count_if(parsed & (F.col("label") == "safe") & (F.col("expected_label") == "conflict")).alias("false_negatives"),
    ).withColumn("passed", F.col("combined_correct") >= F.greatest(F.lit(1).cast("long"), F.floor(F.col("combined_total") * 0.75).cast("long")))


def alignment_acceptance(rows: DataFrame, script: DataFrame) -> DataFrame:
    """Alignment against the edit script: slot, required and localisation accuracy, false edits, weak and uncertain steps."""
    allowed = (
        F.when(F.col("edit") == "delete", F.array(F.lit("delete")))
        .when(F.col("edit") == "replace", F.array(F.lit("replace"), F.lit("uncertain"), F.lit("delete")))
        .when(F.col("edit") == "trim", F.array(F.lit("trim")))
        .otherwise(F.array(F.lit("unchanged")))
    )
    got = rows.where("base_index is not null").select("merge_id", "branch", "base_index", "operation", "confidence")
    j = script.withColumn("allowed", allowed).join(got, ["merge_id", "branch", "base_index"])
    ok = F.array_contains("allowed", F.col("operation"))
    required = F.col("edit").isin("delete", "trim")
    edited, kept = F.col("edit").isin("delete", "replace", "trim"), F.col("edit").isin("keep", "insert_after")
    changed = F.col("operation") != "unchanged"
    return j.groupBy("branch").agg(
        F.count("*").alias("slots"), F.avg(ok.cast("int")).alias("slot_accuracy"), F.avg(F.when(required, ok.cast("int"))).alias("required_accuracy"),
        F.avg(F.when(edited, changed.cast("int"))).alias("localisation"), F.count_if(kept & F.col("operation").isin("delete", "replace")).alias("false_edits"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence"), F.count_if(F.col("operation") == "uncertain").alias("uncertain"),
    )


def false_edits(rows: DataFrame, script: DataFrame) -> DataFrame:
    """(merge_id, branch, unchanged, false_edits): steps that edit a branch whose script edits nothing, inserts among them.

    Null where the script does edit: there an insert may belong to an edit.
    """
    plan = script.groupBy("merge_id", "branch").agg(F.every(F.col("edit") == "keep").alias("unchanged"))
    found = rows.groupBy("merge_id", "branch").agg(F.count_if(F.col("operation").isin("delete", "insert", "replace")).alias("n"))
    return plan.join(found, ["merge_id", "branch"], "left").select("merge_id", "branch", "unchanged", F.when(F.col("unchanged"), F.coalesce("n", F.lit(0))).alias("false_edits"))


def _holds(text: Column, tokens: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(text, t))


def classify_failure(message: Column, error_class: Column) -> Column:
    """Category of a failed attempt: message tokens in order, then the exception's class."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for name, classes in reversed(config.FAILURE_CLASSES.items()):
        out = F.when(error_class.isin(*classes), name).otherwise(out)
    for name, tokens in reversed(config.FAILURE_TOKENS.items()):
        found = _holds(low, [t.lower() for t in tokens])
        out = F.when(found, name).otherwise(out)
    return out


def retryable(status: Column, body: Column, error_class: Column | None = None) -> Column:
    """Whether a call may be tried again.

    Without a response (an ``error_class``) only transport errors may.  Busy
    statuses always may; another status may if its body tells of a busy upstream
    and of no authentication failure.
    """
    low = F.lower(F.coalesce(body, F.lit("")))
    busy = _holds(low, config.RETRY_BODY_TOKENS) & ~_holds(low, config.AUTH_BODY_TOKENS)
    answered = F.coalesce(status.isin(*config.RETRY_STATUSES), F.lit(False)) | busy
    return answered if error_class is None else F.when(error_class.isNotNull(), error_class.isin(*config.TRANSPORT_ERRORS)).otherwise(answered)


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, as a number or an HTTP date against ``now`` (UTC); null unless positive."""
    value = F.btrim(header)
    number = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(value, r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(number, (F.unix_micros(date) - F.unix_micros(now)) / 1e6)
    return F.when(seconds > 0, seconds)


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds before the given attempt's retry: the server's wish, else 2, 5, 10, 20; null beyond the fourth.

    A caller adds up to ``config.RETRY_JITTER`` seconds of chance.
    """
    delays = F.array(*map(F.lit, config.RETRY_DELAYS))
    return F.when(attempt > len(config.RETRY_DELAYS), F.lit(None).cast("double")).otherwise(F.coalesce(retry_after, F.element_at(delays, attempt)))


def attempt_window(attempts: DataFrame, successes: int = config.RUNS_PER_FIXTURE, cap: int = config.FAILED_ATTEMPT_CAP) -> DataFrame:
    """Attempts that the loop would have made: until enough successes, a lasting failure, or too many failures.

    Each attempt sees only what came before it in its fixture; a fixture of
    many attempts fills several parts of the order.
    """
    sums = {"won": F.col("ok"), "lost": ~F.col("ok"), "stopped": ~F.col("ok") & (F.col("category") != "provider")}
    flags = {n: F.coalesce(c.cast("int"), F.lit(0)) for n, c in sums.items()}
    rows = scanned(attempts, ["fixture"], ["attempt"], sums=flags)
    rows = rows.withColumns({n: F.col(n) - c for n, c in flags.items()})
    return rows.where((F.col("won") < successes) & (F.col("lost") < cap) & (F.col("stopped") == 0))


def counter_deltas(snapshots: DataFrame, keys: list[str], order: str, counters: list[str]) -> DataFrame:
    """Change of each counter since the key's snapshot before."""
    rows = scanned(snapshots.select(*keys, order, *counters), keys, [order], before={"earlier": F.struct(*counters)})
    return rows.select(*keys, order, *[(F.col(c) - F.coalesce(F.col("earlier")[c], F.lit(0))).alias(c) for c in counters])


def derived_runs(merges: DataFrame, runs: int = config.RUNS_PER_FIXTURE) -> DataFrame:
    """(fixture, run, interaction, expected, a/b/c statuses): hash-drawn verdicts of repeated runs on each merge.

    Stand-ins for a model's runs: they exercise the evaluation, not the merge.
    """
    rows = merges.select(F.col("merge_id").alias("fixture"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    names = F.array(*map(F.lit, config.INTERACTION_SEVERITY))
    status = F.array(*map(F.lit, config.STATUS_SEVERITY))
    h = draw(F.col("fixture"), F.col("run"), F.lit("run"))
    e = draw(F.col("fixture"), F.lit("expected"))
    pick = lambda array, x, by: F.element_at(array, (F.floor(x / by) % 3 + 1).cast("int"))
    return rows.select(
        "fixture", F.col("run").cast("long").alias("run"), pick(names, h, 1).alias("interaction"), pick(names, e, 1).alias("interaction_expected"),
        *[pick(status, h, 3 ** (i + 1)).alias(f"{v}_status") for i, v in enumerate("abc")], *[pick(status, e, 3 ** (i + 1)).alias(f"{v}_expected") for i, v in enumerate("abc")],
    )


def derived_attempts(events: DataFrame) -> DataFrame:
    """(fixture, attempt, ok, message, error_class, elapsed): an attempt log made of the events, a user as a fixture."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    messages = F.array(*map(F.lit, ["Cloud 503 upstream_503", "ValidationError: missing 'claims'", "no rule matched", "connection reset by peer", "boom"]))
    classes = F.array(*map(F.lit, ["RuntimeError", "ValueError", "KeyError", "TimeoutError", "JSONDecodeError"]))
    ok = F.col("event_type") != "error"
    return events.select(
        F.col("user_id").alias("fixture"), (F.row_number().over(w) - 1).cast("long").alias("attempt"), ok.alias("ok"),
        F.when(~ok, F.element_at(messages, (F.col("event_id") % 5 + 1).cast("int"))).alias("message"),
        F.when(~ok, F.element_at(classes, (F.floor(F.col("event_id") / 5) % 5 + 1).cast("int"))).alias("error_class"), F.col("value").alias("elapsed"),
    )
