"""Each operator against brute force, an exact round trip, a SQL oracle or held-out accuracy."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tributary.llm import bpe, langid, merkle, mixing, pii_sanitise, quality_cnn, quality_rules, registry, simhash_dedup, toxicity_mil

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def frame(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def oracle(name, sf=SF):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return c.sql(registry.ORACLE_SQL[name]).df()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle(name)
    assert sorted(got.columns) == sorted(want.columns)
    key = got.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True)[sorted(got.columns)] for x in (got, want))
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None), check_dtype=False)


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = WORDS.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= radius):
            a, b = find(ids[i]), find(ids[int(j)])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 16}, {"leaf_rows": 8, "bands": 1}, {"bands": 4, "leaf_rows": 8}, {"leaf_rows": 64, "block_rows": 20}])
def test_simhash_against_all_pairs(spark, frame, options):
    docs = spark.createDataFrame(frame)
    got = simhash_dedup.near_duplicates(docs, **options).toPandas().set_index("doc_id")
    sample = frame[::25]
    assert all(int(got.fingerprint[i], 16) == plain_simhash(t) for i, t in zip(sample.doc_id, sample.text))
    ids = got.index.tolist()
    assert got.component_id.to_dict() == plain_components(ids, [int(x, 16) for x in got.fingerprint])


def test_dense_ball_and_long_chain(spark):
    """A group whose members all link, and a chain that only links neighbours."""
    ball = [(i, (1 << (i % 64)) ^ (1 << (i * 7 % 64))) for i in range(1, 500)]
    chain, value = [], 0xFFFF_0000_FFFF_0000
    for i in range(40):
        value ^= 0b111 << (i % 20 * 3)
        chain.append((1000 + i, value))
    rows = dict((v, k) for k, v in reversed(ball + chain))
    classes = spark.createDataFrame([(k, int(np.uint64(v).astype(np.int64))) for v, k in rows.items()], "rep long, fp long")
    got = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(classes, leaf_rows=16, block_rows=50)).collect()}
    want = plain_components([k for k in rows.values()], list(rows))
    assert {k: got.get(k, k) for k in want} == want


def test_binomial_bound(spark):
    from math import comb

    for n, k, p in [(10, 0, 0.02), (250, 3, 0.02), (5000, 80, 0.02), (40, 40, 0.3)]:
        got = spark.range(1).select(quality_rules.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert got == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_rules_keep_their_promise(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = registry.QUERIES["op2_quality_rules"](spark, SF).toPandas().merge(labels, on="doc_id")
    fit = got[~got.base_failed]
    assert fit[fit.quality == 1].kept.mean() >= 0.92


def test_mixing_against_plain_descent(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(0, 300, 400)
    target = {"a": 0.6, "b": 0.3, "c": 0.1}
    table = spark.createDataFrame([(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(t, p))], "doc_id long, n_tokens long, p array<double>")
    got = mixing.fit_rates(table, tuple(target), target).toPandas().sort_values("doc_id")
    wanted = np.array(list(target.values())) * t.sum()
    w = 1 / wanted
    step = 1 / np.linalg.eigvalsh(w[:, None] * (p * t[:, None]).T @ p * w).max()
    r = np.ones(400)
    for _ in range(3000):
        r = np.clip(r - np.where(t > 0, step * p @ (w * w * ((r * t) @ p - wanted)), 0), 0, 4)
    have, plain = (got.rate.to_numpy() * t) @ p, (r * t) @ p
    assert np.abs(have / wanted - 1).max() < 5e-3 and np.abs(plain / wanted - 1).max() < 5e-3
    assert got.rate.min() >= 0 and got.rate.max() <= 4
    assert (got.rate[t == 0] == 1).all()


def test_mixing_reaches_targets_on_documents(spark):
    got = registry.QUERIES["op3_mixing"](spark, SF).toPandas()
    total = got.n_tokens.sum()
    for d, share in mixing.TARGET.items():
        assert (got.rate * got.n_tokens * got[f"p_{d}"]).sum() / total == pytest.approx(share, abs=0.01)
    assert np.allclose(got[[f"p_{d}" for d in mixing.TARGET]].sum(1), 1)


def folded(frame, folds, fold):
    return np.array([zlib.crc32(str(i).encode()) % folds == fold for i in frame.doc_id])


def test_quality_network_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = registry.QUERIES["op5_quality_cnn"](spark, SF).toPandas()
    assert (got.held_out == folded(got, 5, 0)).all() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_network_score_is_independent_of_neighbours(frame):
    import pyarrow as pa

    from tributary.llm.common import text_bytes

    net = quality_cnn.fit(pa.array(frame.text[:60], pa.large_string()), np.arange(60) % 2.0, epochs=1)

    def score(texts):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        codes, begins = quality_cnn.layout(data, offsets)
        start, end, first = quality_cnn.chunks(begins, np.diff(offsets))
        assert all(b > a for a, b in zip(start, end))
        return quality_cnn.combine(net, quality_cnn.pooled(quality_cnn.responses(codes, net.tables()), start, end), first)[0]

    texts = ["", *frame.text[:40], "a"]
    assert np.array_equal(score(texts), np.concatenate([score([t]) for t in texts]))


def test_bpe_equals_the_library(frame):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.BytePairCodec(path)
    library.no_truncation()
    library.no_padding()
    odd = ["", " ", "İΣ ΑΣ", "a\x1cb\x85c", "<|endoftext|>x<|startoftext|>", "don't WE'LL 're", "Å ﬁ ² ٠ 🙂", "x" * 3000]
    for text in [*frame.text[::20], *odd]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_documents_round_trip(spark, frame):
    docs = spark.createDataFrame(frame[:50])
    coded = bpe.encode_documents(docs, with_ids=True)
    digest = {r.doc_id: r.decoded_sha256 for r in coded.collect()}
    for r in bpe.decode_documents(coded).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == digest[r.doc_id]


def test_toxicity_on_held_out_labels_and_location(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = registry.QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert held[held.toxic == 1].predicted.mean() > 0.6 and held[held.toxic == 0].predicted.mean() < 0.03
    model = toxicity_mil.train(toxicity_mil.labelled_sample(docs, labels, "toxic", 3000))
    one = spark.createDataFrame([(1, "Überall the of. You worthless idiot scum there! And on it.")], "doc_id long, text string")
    spans = toxicity_mil.locate(one, model).collect()
    assert [one.first().text[s.start : s.end] for s in spans] == ["You worthless idiot scum there"]


def test_pii_against_plain_patterns(spark, frame):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    extra = ["a@b.c@d.e x@y.z+q@r.s", "1.2.3.4.5.6.7.8", "12345678901234567890 4111-1111 1111 1111", "+1 (2) 3 +44 20 7946 0958.", "ü 🙂 a@b.cd 4111111111111111"]
    rows = [*zip(frame.doc_id.tolist(), frame.text), *[(10_000 + i, t) for i, t in enumerate(extra)]]

    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(q) <= 255 for q in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    got = {r.doc_id: r for r in pii_sanitise.digests(pii_sanitise.sanitised_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        spans = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if valid(k, m.group())]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = Counter(k for k, _, _ in spans)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text[:80]
        assert [got[i][f"n_{k}"] for k in plain] == [counts[k] for k in plain]
        assert ",".join(s for s in got[i].spans.split(",") if s and not s.startswith("term")) == listed


def test_disclosing_terms_by_brute_force(spark):
    rows = [(i, f"alpha{'bcdefgh'[i % 7]} zorblax wrote to ann@x.org about number {i} today") for i in range(6)]
    rows += [(10 + i, f"the usual words about number {i} today from bob{i}@y.org") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii_sanitise.digests(pii_sanitise.sanitised_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    named = {i: {t[int(a) : int(b)] for a, b in re.findall(r"term:(\d+):(\d+)", got[i])} for i, t in rows}
    assert all("zorblax" in named[i] for i in range(6))
    assert all(not named[10 + i] & {"the", "about", "number", "today", "from"} for i in range(40))


def test_merkle_against_brute_force(spark, frame):
    order = frame.sort_values("doc_id", ascending=False).reset_index(drop=True)
    for parts in (1, 7):
        got = merkle.compare_with_next(spark.createDataFrame(frame), parts).toPandas().set_index("doc_id")
        assert len(got) == len(frame)
        for i, (doc_id, text) in enumerate(zip(order.doc_id, order.text)):
            after = order.text[(i + 1) % len(order)]
            half = len(text) // 2
            changed = text[: len(text) - half] + after[:half]
            r = got.loc[doc_id]
            assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(text)
            if i % 40 == 0:
                (a, b, c), _ = merkle.trees([text, changed, after])
                assert (r.fingerprint, r.edited_fingerprint) == (a, b)
                assert (r.near_edited, r.near_next) == (merkle.likeness(a, b), merkle.likeness(a, c))
    assert got.fingerprint.nunique() == frame.text.nunique()
    assert got.near_edited.mean() > 0.45 > 0.15 > got.near_next.mean()


def test_merkle_locates_edits():
    lines = [f"Line number {i} says this. And that." for i in range(40)]
    (a, b), _ = merkle.trees(["\n".join(lines), "\n".join([*lines[:17], "Something else here.", *lines[18:]])])
    assert merkle.differing_paragraphs(a, b) == [17] and merkle.differing_paragraphs(a, a) == []


def test_language_on_held_out_documents(spark):
    got = registry.QUERIES["op10_langid"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == folded(got, 4, 2)).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_document_frequencies_by_brute_force(spark, frame):
    docs = spark.createDataFrame(frame[:40])
    seen, total = langid.document_frequencies(docs)
    want = defaultdict(set)
    for i, text in enumerate(frame.text[:40]):
        points = np.array([langid._FOLD[ord(c)] if ord(c) < 0x250 else ord(c) for c in text], np.uint32)
        for order in langid.ORDERS:
            for h in langid.ngram_buckets(points, np.array([0, len(points)]), order)[0]:
                want[int(h)].add(i)
    assert total == 40 and {int(i): int(seen[i]) for i in np.flatnonzero(seen)} == {k: len(v) for k, v in want.items()}


def test_pipeline_against_its_parts(spark):
    """run() keeps what the rules keep, one document of each group, and encodes the redacted texts."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    rules = registry.QUERIES["op2_quality_rules"](spark, SMALL).toPandas()
    kept = docs[docs.doc_id.isin(rules[rules.kept].doc_id)]
    roots = plain_components(kept.doc_id.tolist(), [plain_simhash(t) for t in kept.text])
    single = {i for i, r in roots.items() if i == r}
    assert set(out.doc_id) <= single and len(out) >= 0.85 * len(single)
    texts = {r.doc_id: r.text for r in pii_sanitise.redact(spark.createDataFrame(kept[kept.doc_id.isin(single)])).collect()}
    own = bpe.BytePairCodec(bpe.default_vocabulary())
    for r in out[::9].itertuples():
        ids = own.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and list(r.ids) == ids
