"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import bpe, importance, langid, merkle, mixing, pii_sanitise, quality_cnn, quality_rules, simhash_dedup, token_files, toxicity_mil, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, m string, rate string, text_hash string, span_id string, rated_id string, label int"
LABELS = "doc_id long, quality int, toxic int, domain string, text string"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), 1, 0.5, "m", "r", "h", "x", "y", 3)


@pytest.fixture(scope="module")
def docs(spark):
    prose = " ".join(f"word{i} went over the hill number{i}." for i in range(60))
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, prose), row(4, prose), row(5, prose), row(None, prose), row(None, None),
        row(6, "a"), row(7, "Ünïcödé ß 中文 🙂 mail me at a.b@c.de or +1 (499) 555-6503!"), row(8, "long " * 60_000), row(9, "x" * 200_000 + "@y.z"),
        row(10, "1" * 50_000), row(11, prose, None), row(12, "scum and trash.\nfine words here."), row(13, "1.2.3.4.5 999.1.1.1 4111 1111 1111 1111"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (4, 1, 0), (5, 1, 0), (12, 0, 1), (2, 0, 0), (None, 1, 1), (7, None, 1), (8, 1, None), (99, 1, 0)]
    return spark.createDataFrame([(*r, "d", "t") for r in rows], LABELS)


def empty(df):
    return df.where(F.lit(False))


OPERATORS = {
    "dedup": lambda d, l: simhash_dedup.near_duplicates(d),
    "rules": lambda d, l: quality_rules.quality_rules(d, l),
    "mixing": lambda d, l: mixing.mixing_rates(d, l),
    "cnn": lambda d, l: quality_cnn.score_documents(d, quality_cnn.train(toxicity_mil.labelled_sample(d, l, "quality", 100), epochs=1)),
    "bpe": lambda d, l: bpe.encode_documents(d, with_ids=True),
    "toxicity": lambda d, l: toxicity_mil.score_documents(d, toxicity_mil.train(toxicity_mil.labelled_sample(d, l, "toxic", 100), epochs=3)),
    "pii": lambda d, l: pii_sanitise.digests(pii_sanitise.sanitised_spans(d)),
    "merkle": lambda d, l: merkle.compare_with_next(d, 3),
    "langid": lambda d, l: langid.predict(d, langid.train(d, 100)),
    "tokens": lambda d, l: token_files.encoded(d),
    "importance": lambda d, l: importance.resample(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_judged(name, docs, labels):
    out = OPERATORS[name](docs, labels)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    want = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, labels):
    assert OPERATORS[name](empty(docs), labels).count() == 0
    assert OPERATORS[name](docs, empty(labels)).count() == docs.count()
    assert OPERATORS[name](empty(docs), empty(labels)).count() == 0


def test_defined_results_for_null_and_empty(docs, labels):
    rows = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint == rows[3].fingerprint == "0" * 16
    assert rows[3].component_id == 1 and rows[5].component_id == 4
    coded = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (coded[1].n_tokens, coded[1].ids_sha256, coded[1].decoded_sha256) == (0, nothing, nothing)
    spans = {r.doc_id: r for r in pii_sanitise.digests(pii_sanitise.sanitised_spans(docs)).collect()}
    assert spans[1].base_sha256 == nothing and spans[1].spans == ""
    assert (spans[13].n_ip, spans[13].n_card, spans[7].n_phone, spans[7].n_email) == (1, 0, 1, 1)
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert rules[1].n_words == 0 and rules[1].base_failed and not rules[1].kept
    lang = {r.doc_id: r for r in langid.predict(docs, langid.train(docs, 100)).collect()}
    assert lang[1].lang_pred == lang[10].lang_pred == "und" and lang[1].score == 0
    merkled = {r.doc_id: r for r in merkle.compare_with_next(docs, 3).collect()}
    assert merkled[1].n_chars == 0 and merkled[1].near_edited == 1.0


def test_stages_keep_columns_and_rows(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, empty(docs)):
        current = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, current, str(tmp_path))
            if name != "encoding":
                assert out.columns == docs.columns
            current = out
        kept = [r.doc_id for r in current.select("doc_id").collect()]
        assert len(kept) <= given.count()
    one = [r.doc_id for r in simhash_dedup.keep_one(docs).select("doc_id").collect()]
    assert sorted(x for x in one if x is not None) == [1, 4, 6, 7, 8, 9, 10, 12, 13] and one.count(None) == 2
    text = {r.doc_id: r.text for r in pii_sanitise.redact(docs).select("doc_id", "text").collect()}
    assert text[7] == "Ünïcödé ß 中文 🙂 mail me at [EMAIL] or [PHONE]!" and text[1] is None
    assert text[13] == "[IP].5 999.1.1.1 4111 1111 1111 1111"


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://A.Example.COM/en/x?q"), (5, "http://www.example.com/en/1"), (6, "http://x.net/fr/"), (7, "http://free-bets.q.org/"), (7, "http://free-bets.q.org/"), (None, "http://b.com/")]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = sorted(tuple(r) for r in url_filter.filter_urls(pages).select(F.coalesce("page_id", F.lit(0)), "host", "path", F.coalesce("rule", F.lit("-")), "verdict").collect())
    assert got == sorted(
        [
            (1, "", "", "-", "allow"), (2, "", "", "-", "allow"), (3, "", "", "-", "allow"), (4, "a.example.com", "/en/x", "example.com/en/", "block"), (5, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
            (6, "x.net", "/fr/", "net/fr/", "block"), (7, "free-bets.q.org", "/", "-", "block"), (7, "free-bets.q.org", "/", "-", "block"), (0, "b.com", "/", "com/", "allow"),
        ]
    )
    assert url_filter.filter_urls(pages.where("false")).count() == 0
