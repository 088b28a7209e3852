"""Ordinal join, category sums and false edits on small inputs."""

from tributary.operators import evaluate, gate


def test_shots_meet_the_line_of_their_number(spark):
    shots = spark.createDataFrame([("f", "base", 0, "a"), ("f", "base", 1, None), ("f", "base", 2, "more"), ("f", "branch_a", 0, "x"), ("g", "base", 0, "y")], "fixture string, branch string, shot_no long, text string")
    script = spark.createDataFrame([("f", "base", 0, "A"), ("f", "base", 1, "B"), ("f", "branch_a", 0, "X"), ("f", "branch_a", 1, "unsaid")], "fixture string, branch string, line_no long, text string")
    got = sorted(tuple(r) for r in gate.by_ordinal(shots, script).collect())
    assert got == [("f", "base", 0, "A", "a"), ("f", "base", 1, "B", ""), ("f", "base", 2, "", "more"), ("f", "branch_a", 0, "X", "x"), ("g", "base", 0, "", "y")]


def test_category_sums_count_shots_of_all_videos(spark):
    rows = [("f", "base", 0, "negation", "not"), ("f", "base", 0, "negation", "never"), ("f", "base", 1, "negation", "no"), ("f", "branch_a", 0, "negation", "no"), ("f", "branch_a", 0, "causal", "because"), ("g", "base", 0, "causal", "because")]
    got = gate.category_sums(spark.createDataFrame(rows, "fixture string, branch string, shot_no long, category string, marker string")).collect()
    assert {(r.fixture, r.category): r.shots for r in got} == {("f", "negation"): 3, ("f", "causal"): 1, ("g", "causal"): 1}


def test_inserts_are_false_edits_of_an_unchanged_branch(spark):
    steps = [(1, "a", "unchanged"), (1, "a", "insert"), (1, "a", "delete"), (1, "a", "uncertain"), (1, "b", "insert"), (2, "a", "unchanged")]
    script = [(1, "a", "keep"), (1, "a", "keep"), (1, "b", "keep"), (1, "b", "trim"), (2, "a", "keep"), (3, "a", "keep")]
    got = evaluate.false_edits(spark.createDataFrame(steps, "merge_id long, branch string, operation string"), spark.createDataFrame(script, "merge_id long, branch string, edit string")).collect()
    assert {(r.merge_id, r.branch): (r.unchanged, r.false_edits) for r in got} == {(1, "a"): (True, 2), (1, "b"): (False, None), (2, "a"): (True, 0), (3, "a"): (True, 0)}
