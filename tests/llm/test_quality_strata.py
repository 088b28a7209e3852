"""Verdicts of the strata: planted bad documents go, and the bound holds over repeated draws."""

from math import comb

import duckdb
import numpy as np
import pytest

from tributary.llm import quality_rules as rules


def least_good(bound, level):
    return next(n for n in range(1, 10_000) if (1 - bound) ** n <= level)


def test_a_stratum_with_203_good_documents_rejects_planted_bad_ones(spark):
    assert least_good(0.02, 0.05 / 3) == 203
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(4_000)]
    docs, labels = [], []
    for stratum, (size, good) in {"short": (80, 203), "medium": (300, 203), "long": (1100, 150)}.items():
        for kind, n in ((1, good), (0, 12)):
            for _ in range(n):
                i = len(docs)
                text = " ".join(rng.choice(words, size))
                docs.append((i, text if kind else text.upper(), stratum))
                labels.append((i, kind))
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, s string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for stratum, judged in (("short", True), ("medium", True), ("long", False)):
        bad = [got[i].kept for (i, _, s), (_, k) in zip(docs, labels) if s == stratum and not k]
        good = [got[i].kept for (i, _, s), (_, k) in zip(docs, labels) if s == stratum and k]
        assert all(good) and (not any(bad) if judged else all(bad)), stratum


def by_hand(worst, bound=0.02, level=0.05 / 3):
    """Strictest cutoff of the nested sequence, tested one after the other from loose to strict."""
    n, chosen = len(worst), None
    for g in sorted(rules.GRID, reverse=True):
        k = int((worst > g).sum())
        if sum(comb(n, j) * bound**j * (1 - bound) ** (n - j) for j in range(k + 1)) > level:
            break
        chosen = g
    return chosen


def table_of(spark, worst):
    rows = [(i, "short", False, float(x), 0.0, float(x) / 2, 0.0) for i, x in enumerate(worst)]
    return spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"{r} double" for r in rules.RULES))


@pytest.mark.parametrize("n, scale", [(202, 0.02), (203, 0.02), (600, 0.05), (2000, 0.1)])
def test_cutoffs_by_hand(spark, n, scale):
    worst = np.random.default_rng(n).exponential(scale, n)
    if n < 204:
        worst = np.minimum(worst, 0.1)
    got = rules.cutoffs(table_of(spark, worst), spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")).collect()
    assert [r.cutoff for r in got] == [c for c in [by_hand(worst)] if c is not None]
    assert bool(got) == (n > 202)


def test_the_bound_holds_over_many_draws():
    """Of many labelled samples, one in sixty at most may choose a cutoff that rejects more than 2 % of all good documents."""
    rng = np.random.default_rng(4)
    broken = 0
    for _ in range(600):
        chosen = by_hand(rng.exponential(0.08, 400))
        broken += chosen is not None and np.exp(-chosen / 0.08) > 0.02
    assert broken / 600 <= 0.05 / 3 + 3 * (0.0167 * 0.9833 / 600) ** 0.5


def test_sql_agrees_where_every_stratum_has_a_verdict(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    table = rules.quality_rules(docs, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = {r[0]: r[1] for r in con.sql(f"select doc_id, kept from ({rules.ORACLE})").fetchall()}
    rows = table.select("doc_id", "stratum", "base_failed", "kept").collect()
    assert {r.doc_id: r.kept for r in rows} == want
    assert {r.stratum for r in rows if not r.kept and not r.base_failed} == set(rules.STRATA)
