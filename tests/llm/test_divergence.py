"""The source audit against its SQL and against a dense evaluation."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tributary.llm import divergence

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def dense(docs, min_df=10, top=10):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    frequency, counts, groups = Counter(), {}, sorted({d[1:] for d in docs})
    for text, lang, source in docs:
        found = TERM.findall(text.translate(UPPER))
        frequency.update({(lang, t) for t in found})
        counts.setdefault((lang, source), Counter()).update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (own, t), n in frequency.items() if own == lang and n >= min_df)
        sources = [s for own, s in groups if own == lang]

        def values(counter):
            below = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // below for t in kept}

        p = {s: values(counts[lang, s]) for s in sources}
        q = values(sum((counts[lang, s] for s in sources), Counter()))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            marked = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(marked)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(rows, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_sql_and_dense_evaluation(spark):
    got = rows(divergence.op11_source_divergence(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()
    assert got == dense([tuple(r) for r in docs])
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.sql(divergence.ORACLE).fetchall())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    words = ["the", "The", "é", "中文", "x", "UPPER", "a_b", "c3d", "\0"] + [f"w{chr(97 + i)}" for i in range(26)]
    docs = [(None, None, None), ("", "en", "blank"), ("12 34", "en", "digits"), ("one two", "xx", "alone"), ("one two", "xx", "other"), ("hot " * 20_000, "en", "s0")]
    for _ in range(400):
        source = "s0" if rng.random() < 0.4 else rng.choice([None, "", "s1", "s2", "é"])
        docs.append((" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "en", "en", "de", None]), source))
    return docs + [docs[10]] * 15


@pytest.mark.parametrize("vocabulary", [divergence.VOCABULARY, 7])
def test_odd_rows_and_several_vectorizers(spark, odd, vocabulary):
    df = spark.createDataFrame([(*d, 1, "t") for d in odd], "text string, lang string, source string, value int, term string")
    got = rows(divergence.audit(df.repartition(5), vocabulary=vocabulary))
    assert got == dense(odd)
    assert ("xx", "alone", "pair", "other", 0, 1) in got


def test_many_groups_are_keyed_by_their_names(spark, odd, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 3)
    df = spark.createDataFrame(odd, "text string, lang string, source string")
    assert rows(divergence.audit(df)) == dense(odd)


def test_empty_table(spark, odd):
    df = spark.createDataFrame(odd, "text string, lang string, source string")
    assert divergence.audit(df.where(F.lit(False))).count() == 0


def test_document_counts_are_those_of_the_bags(spark, odd):
    odd = odd + [("Ééa ABC-İ\u2028x\x7fy\x80z abc", "en", "s0"), ("the é" * 3, None, "s1"), (" ", "de", None)]
    df = spark.createDataFrame(odd, "text string, lang string, source string").repartition(3)
    got = df.transform(divergence.document_counts).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    want = Counter((lang or "", t) for text, lang, _ in odd for t in set(TERM.findall((text or "").translate(UPPER))))
    assert {(r.lang, r.term): r.n for r in got.collect()} == dict(want)
    bagged = divergence.bags(df).select("lang", F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang", "term").count()
    assert {(r.lang, r.term): r["count"] for r in bagged.collect()} == dict(want)


def test_all_rows_as_sql_on_a_larger_table(spark):
    larger = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{larger}/documents.parquet'")
    assert rows(divergence.op11_source_divergence(spark, larger)) == sorted(con.sql(divergence.ORACLE).fetchall())


@pytest.mark.parametrize("most", [divergence.GROUPS, 3])
def test_one_pass_counts_documents_and_occurrences_of_each_group(spark, odd, monkeypatch, most):
    monkeypatch.setattr(divergence, "GROUPS", most)
    df = spark.createDataFrame(odd, "text string, lang string, source string").repartition(3)
    groups = df.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source").distinct()
    documents, occurrences = Counter(), Counter()
    for text, lang, source in odd:
        found = [(lang or "", source or "", t) for t in TERM.findall((text or "").translate(UPPER))]
        documents.update(set(found))
        occurrences.update(found)
    got = divergence.term_counts(df, groups).collect()
    assert {tuple(r)[:3]: (r.documents, r.n) for r in got} == {k: (n, occurrences[k]) for k, n in documents.items()} and len(got) == len(documents)
