"""Exact values of single operators, nulls and borders included."""

import pytest
from pyspark.sql import functions as F

from tributary import config
from tributary.functions import similarity as S
from tributary.functions import text as T
from tributary.operators import claims, evaluate
from tributary.operators.align import infer_operation


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(*tokens):
    return F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "a, b, want",
    [
        (["a", "a", "b"], ["a", "b", "b"], 0.5), ([], [], None), (["a"], [], 0.0), (["x", "y", "x", "y"], ["x", "y"], 1.0),
        (["x", "x"], ["x"], 0.5), (["x", "x", "x", "x"], ["x", "x"], 1.0), (["a", "b", "a"], ["a", "c"], 0.25),
    ],
)
def test_multiset_jaccard(spark, a, b, want):
    assert value(spark, T.multiset_jaccard(words(*a), words(*b))) == want


@pytest.mark.parametrize("t, want", [(["x", "y", "x", "y"], ["x", "y"]), (["x", "x"], ["x", "x"]), (["x"] * 4, ["x", "x"]), (["a", "b", "c"], ["a", "b", "c"]), ([], []), (["a", "b", "c"] * 3, ["a", "b", "c"])])
def test_collapse_repeats(spark, t, want):
    assert value(spark, T.collapse_repeats(words(*t))) == want


def test_text(spark):
    assert value(spark, T.normalize(F.lit("  Don't  STOP--now!\n"))) == "don t stop now"
    assert value(spark, T.normalize(F.lit(None).cast("string"))) == ""
    assert value(spark, T.tokens(F.lit(""))) == []
    assert value(spark, T.gate_tokens(F.lit("Customers' allergies: ten boxes, bus's glass days is"))) == ["customer", "allergy", "10", "box", "bus", "glass", "day", "is"]
    assert value(spark, T.set_jaccard(words(), words())) == 1.0
    assert value(spark, T.clock_millis(F.lit(75.25))) == "01:15.250" and value(spark, T.clock_millis(F.lit(-3.0))) == "00:00.000"
    assert value(spark, T.unfenced_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    lines = "[00:05–00:10] 'one'\nnot a line\n  [01:00–01:30] 'it's two'  "
    assert [tuple(r) for r in value(spark, T.parse_clock_lines(F.lit(lines)))] == [(5.0, 10.0, "one"), (60.0, 90.0, "it's two")]
    prose = "Keep 'a.b' as is. 'x' was\n--> DELETED and 'y' --> TRIMMED, 'z' --> REPLACED"
    assert [value(spark, T.marked_edit(F.lit(t), F.lit(prose))) for t in ("x", "y", "z", "q")] == ["delete", "trim", "replace", None]


def test_hashes_and_colours(spark):
    ones = "f" * 16
    assert value(spark, S.hamming(F.lit(ones), F.lit("0fffffff0fffffff"))) == 8
    assert value(spark, S.hamming(F.lit(""), F.lit(ones))) == 0
    zero = F.lit(config.ZERO_HASH)
    assert value(spark, S.structure(zero, zero)) is None and value(spark, S.structure(zero, F.lit(ones))) == 0.0
    rgb = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert value(spark, S.mean_rgb(rgb(0, 0, 0), rgb(1, 1, 1))) == 0.0 and value(spark, S.mean_rgb(rgb(0, 0, 0), rgb(0.5, 0, 0))) == 0.75
    null = F.lit(None).cast("array<double>")
    assert value(spark, S.mean_rgb(null, null)) is None and value(spark, S.histogram(null, rgb(1))) == 0.0
    assert value(spark, S.histogram(rgb(0.5, 0.5), rgb(0.25, 0.75))) == 0.75 and value(spark, S.histogram(rgb(1), rgb(0.5, 0.5))) == 0.0


def test_scores(spark):
    d = lambda x: F.lit(x).cast("double")
    assert value(spark, S.duration(d(3.0), d(2.4))) == pytest.approx(0.8) and value(spark, S.relative_gap(d(3.0), d(2.4))) == pytest.approx(0.2)
    assert value(spark, S.duration(d(0), d(0))) == 1.0 and value(spark, S.relative_gap(d(0), d(0))) == 0.0
    assert [value(spark, S.order_prior(F.lit(0), F.lit(j))) for j in (0, 2, 4, 9)] == [1.0, 0.5, 0.0, 0.0]
    assert value(spark, S.order_prior(F.lit(5), F.lit(0))) == 1.0 and value(spark, S.order_prior(F.lit(-1), F.lit(0))) is None
    none = d(None)
    assert value(spark, S.blend(none, none, d(1), d(1))) == pytest.approx(1.0) and value(spark, S.blend(none, none, none, none)) == 0.0
    assert value(spark, S.used_components(none, none, d(1), d(1))) == "duration_similarity,order_similarity"
    assert value(spark, S.visual(d(1), none, d(0))) == pytest.approx(0.4 / 0.7)


@pytest.mark.parametrize(
    "visual, transcript, gap, speech, want",
    [
        (1.0, 1.0, 0.05, True, "unchanged"), (0.9, 0.6, 0.2, True, "trim"), (0.95, 0.1, 0.0, True, "replace"), (0.6, 1.0, 0.0, True, "replace"), (None, 1.0, 0.0, True, "uncertain"),
        (0.4, 0.1, 0.0, True, "uncertain"), (0.95, 0.9, 0.5, True, "uncertain"), (1.0, None, 0.0, False, "unchanged"), (1.0, 0.0, 0.0, None, "replace"),
    ],
)
def test_operations(spark, visual, transcript, gap, speech, want):
    d = lambda x: F.lit(x).cast("double")
    b, r = (F.lit(speech), F.lit(speech)) if speech is not None else (F.lit(True), F.lit(False))
    assert value(spark, infer_operation(F.lit(0), F.lit(0), d(visual), d(transcript), d(gap), b, r)) == want


def test_interaction_rules_exhaustively(spark):
    names = list(config.STATUS_SEVERITY)
    rows = [(a, b, c) for a in names for b in names for c in names]
    what, which = claims.rule(F.col("a"), F.col("b"), F.col("c"))
    got = spark.createDataFrame(rows, "a string, b string, c string").select("a", "b", "c", what.alias("w"), which.alias("r")).collect()
    assert sum(r.w == "creates_new_conflict" for r in got) == 4
    assert {k: sum(r.r == k for r in got) for k in ("R1", "R2", "R3", "R4")} == {"R1": 4, "R2": 5, "R3": 9, "R4": 9}
    assert all((r.w != "none") == (r.c == "broken" and "broken" not in (r.a, r.b)) for r in got)


def test_failures(spark):
    c = lambda m, e: value(spark, evaluate.classify_failure(F.lit(m).cast("string"), F.lit(e)))
    assert c("ValidationError after upstream_503", "ValueError") == "provider" and c("missing 'claims' key", "RuntimeError") == "schema"
    assert c("no rule matched", "X") == "semantic" and c(None, "JSONDecodeError") == "schema" and c("boom", "KeyError") == "orchestrator" and c("boom", "OSError") == "unknown"
    assert value(spark, evaluate.retryable(F.lit(200), F.lit("overload"))) and not value(spark, evaluate.retryable(F.lit(401), F.lit("overload: invalid api key")))
    assert [value(spark, evaluate.backoff(F.lit(i), F.lit(None).cast("double"))) for i in (1, 2, 3, 4, 5)] == [2.0, 5.0, 10.0, 20.0, None]
