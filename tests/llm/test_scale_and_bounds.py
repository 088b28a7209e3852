"""Many rules, long texts in fragments, unlike long texts, repeated ids and the bound of a stratum's verdict."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.llm import langid, merkle, mixing, pii_sanitise, quality_cnn, quality_rules, simhash_dedup, toxicity_mil, url_filter
from tributary.llm.common import drawn, text_bytes, texts_of


def test_thousands_of_patterns_equal_running_them_all(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 5))) for _ in range(900)]
    forms = ["[/.-]{}[0-9]*[/.-]", "[/.]{}-[a-z]+[.]", "{}", "-{}[.]", "(?:x|[/.]){}[.]", "[/.]{}s?[/.]", "[^a]{}[/.]", "[/.]{}[.]org"]
    rules = spark.createDataFrame([(i, rng.choice(forms).format(rng.choice(names))) for i in range(5000)], "rank long, expression string")
    patterns = url_filter.patterns_of(rules)
    urls = [f"http://{rng.choice('wxyz')}{rng.choice('.-')}{rng.choice(names)}{rng.choice(['', '7', '88', '-win', 's'])}{rng.choice('./-')}org/{rng.choice('qrstu')}" for _ in range(120)]
    got = {r.page_id: r.pattern for r in url_filter.filter_urls(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), patterns=patterns).collect()}
    compiled = [(p.expression, re.compile(p.expression)) for p in patterns]
    assert got == {i: next((e for e, c in compiled if c.search(u)), None) for i, u in enumerate(urls)}
    assert sum(bool(p.tokens) for p in patterns) > 500


def test_verdict_of_each_stratum_keeps_its_bound(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for r in quality_rules.base_rejections(quality_rules.quality_rules(docs, labels), labels).collect():
        assert r.by_rules <= 0.02 * r.n_good, r


def test_long_texts_in_fragments(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join(f"{'ab' * (i % 5)}word{i % 97}, Ünïcödé{'.' if i % 13 == 0 else ''}{'!' if i % 51 == 0 else ''} word word" for i in range(600))
    data, offsets = text_bytes(pa.array([text]))
    model = toxicity_mil.Model(rng.normal(0, 0.3, toxicity_mil.BUCKETS).astype(np.float32), -3.0)
    buckets, bounds, _, starts, ends = toxicity_mil.sentences(data, offsets)
    p, first, last = toxicity_mil.long_text_sentences(data, model, 700)
    assert np.allclose(p, toxicity_mil.sentence_scores(buckets, bounds, model)) and (first == starts[bounds[:-1]]).all() and (last == ends[bounds[1:] - 1]).all()
    judge = mixing.Classifier(("a", "b"), rng.normal(0, 1, (mixing.BUCKETS, 2)), rng.normal(0, 1, (mixing.DENSE, 2)), np.zeros(2))
    b, at, dense, tokens = mixing.measures(data, offsets)
    s, n = mixing.long_text_logits(data, judge, 700)
    assert np.allclose(s, mixing.logits(b, at, dense, judge)) and n == tokens
    net = quality_cnn.fit(pa.array([text, "x"], pa.large_string()), np.array([1.0, 0.0]), epochs=1)
    codes, begins = quality_cnn.layout(data, offsets)
    start, end, _ = quality_cnn.chunks(begins, np.diff(offsets))
    whole = quality_cnn.pooled(quality_cnn.responses(codes, net.tables()), start, end)
    assert np.array_equal(quality_cnn.long_text_tops(data, net.tables(), 3)[0], whole)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    plain = np.sort(np.concatenate([g for _, g in langid.ngrams(batch, 0)]))
    monkeypatch.setattr(langid, "FRAGMENT", 501)
    assert np.array_equal(np.sort(np.concatenate([g for _, g in langid.ngrams(batch, 0)])), plain)


def test_convolution_against_a_plain_loop():
    rng = np.random.default_rng(3)
    net = quality_cnn.fit(pa.array(["a"], pa.large_string()), np.zeros(0))
    codes = rng.integers(0, 512, 60)
    got = quality_cnn.responses(codes, net.tables())
    want = [[sum(net.embed[codes[i + w]] @ net.filters[w, :, f] for w in range(quality_cnn.WIDTH)) for f in range(quality_cnn.FILTERS)] for i in range(len(codes) - quality_cnn.WIDTH + 1)]
    assert np.allclose(got, want, atol=1e-4)


def test_noisy_or_learns_from_document_labels():
    texts = [f"fine words {i} here. {'vile ' if i % 2 else ''}things {i}." for i in range(80)]
    data, offsets = text_bytes(pa.array(texts))
    buckets, bounds, per_row, _, _ = toxicity_mil.sentences(data, offsets)
    model = toxicity_mil.fit(np.arange(80) % 2.0, buckets, bounds * toxicity_mil.FEATURES, per_row)
    p = toxicity_mil.sentence_scores(buckets, bounds, model)
    score = toxicity_mil.noisy_or(p, per_row)
    assert ((score > 0.7) == (np.arange(80) % 2 == 1)).all()
    for i in range(5):
        own = p[per_row[i] : per_row[i + 1]]
        assert score[i] == pytest.approx(1 - np.prod(1 - own))


def test_unlike_long_texts_share_nothing_and_ids_spread(spark):
    a, b = (merkle.grown([" ".join(f"{c}{i}." for i in range(200_000))])[0] for c in "ab")
    assert merkle.likeness(a, b) < 1e-4
    rows = [(None, f"text {i}") for i in range(300)] + [(7, f"same id {i}") for i in range(300)] + [(i, f"t {i}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = merkle.beside_next(docs, 8)
    sizes = [r.n for r in dealt.where("not tail").groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 660 and max(sizes) < 250 and dealt.where("tail").count() <= 2 * len(sizes)
    assert merkle.compare_with_next(docs, 8).count() == 660


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "one text that stands alone with words of its own"), (1, "and a second one that says other things at length"), (2, "and a second one that says other things at length"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"similarity": 0.8, "shingle": 5}):
        assert sorted(map(tuple, simhash_dedup.keep_one(docs, **options).collect()), key=str) == sorted([rows[0], rows[1], rows[3]], key=str)


def test_draw_is_bounded_in_rows_and_bytes(spark):
    keys = spark.createDataFrame([(i, "rare" if i < 5 else "usual") for i in range(500)], "doc_id long, kind string")
    docs = spark.createDataFrame([(i % 500, "x" * (100 + i % 7)) for i in range(3000)], "doc_id long, text string")
    chosen = drawn(keys, 100, 1, by="kind")
    kinds = [r.kind for r in chosen.collect()]
    assert len(kinds) <= 100 and kinds.count("rare") == 5
    got = texts_of(docs, chosen, 2_000).collect()
    assert len({r.doc_id for r in got}) == len(got) and 10 < sum(len(r.text) for r in got) <= 2_000


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{i}@b.cd {i % 250}.2.3.4 w" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii_sanitise.digests(pii_sanitise.sanitised_spans(docs)).first()
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a\d+@b\.cd", text)] + [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"(?<=cd )[\d.]+", text)]
    assert r.spans.split(",") == want
    assert pii_sanitise.redact(docs).first().text == " ".join(["[EMAIL] [IP] w"] * 3000)


def test_mixing_fit_needs_little_memory_and_gives_the_plain_scores():
    rng = np.random.default_rng(3)
    n, size, k = 400, 1000, 3
    domain = rng.integers(0, k, n)
    raw = [np.sort((rng.zipf(1.3, size) + 40 * d) % mixing.BUCKETS) for d in domain]
    rows = [np.unique(r, return_counts=True) for r in raw]
    buckets, times = (np.concatenate([r[i] for r in rows]).astype(np.int32) for i in (0, 1))
    bounds = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    dense = rng.normal(0, 1, (n, mixing.DENSE))
    # One step of the plain form, over every word of every row.
    model = mixing.fit(domain, ("a", "b", "c"), buckets, times, bounds, dense, epochs=1)
    g = (np.full((n, k), 1 / k) - np.eye(k)[domain]) / n
    plain = np.zeros((mixing.BUCKETS, k))
    for row, r in enumerate(raw):
        np.add.at(plain, r, g[row] * size**-mixing.DAMPING)
    held = np.bincount(buckets, minlength=mixing.BUCKETS)
    assert not model.words[held < 5].any()
    clear = (held >= 5)[:, None] & (np.abs(plain) > 1e-5)
    assert clear.sum() > 100 and (np.sign(model.words[clear]) == -np.sign(plain[clear])).all()
    tracemalloc.start()
    model = mixing.fit(domain, ("a", "b", "c"), buckets, times, bounds, dense, epochs=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The parameters of all buckets, and 60 bytes an entry: less than the words of the rows themselves took.
    assert peak < 14 * 8 * k * len(np.unique(buckets)) + 8 * k * mixing.BUCKETS + 8 * mixing.BUCKETS * 2 + 60 * len(buckets) + (1 << 20)
    s = mixing.logits(np.concatenate(raw), np.arange(n + 1) * size, dense, model)
    assert (s.argmax(1) == domain).mean() > 0.9
