"""Importance resampling against a plain loop over whole texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def by_hand(docs, targets, percent=25, min_words=20):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, texts in ((s, [d[1] for d in docs]), (t, targets)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10_000) / ((a + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    target = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
    got = importance.op13_importance(spark, f"/root/testdata/{sf}")
    assert rows(got) == by_hand([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_odd_texts(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "x9", "née", "中文", "w" * 64, "v" * 65, "u" * 300, "a" * 63]
    texts = [None, "", "\n\n", "one", "\nend\n", "a\r\nb", "x" * 70_000, "hot line\n" * 5_000, "a b\na b\n\nc", "é\né"]
    texts += ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = [(i if i % 9 else 5, t) for i, t in enumerate(texts)] + [(None, "no id " * 12), (None, None), (5, "again " * 30), (5, "again " * 30)]
    df = spark.createDataFrame([(d, t, 1, b"k", 2, 3) for d, t in docs], "doc_id long, text string, n long, key binary, gain long, rank long")
    target = spark.createDataFrame([("alpha beta\nx9",), (None,), ("",)], "text string")
    assert rows(importance.resample(df, target)) == by_hand(docs, ["alpha beta\nx9", None, ""])
    assert rows(importance.resample(df.repartition(9), target)) == by_hand(docs, ["alpha beta\nx9", None, ""])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert importance.resample(docs.where(F.lit(False)), docs).count() == 0
    assert rows(importance.resample(docs, docs.where(F.lit(False)))) == by_hand([(1, "some words here")], [])


def test_lines_are_counted_once_and_weighted(spark):
    docs = spark.createDataFrame([(i, "same line here\nown%d" % i) for i in range(40)], "doc_id long, text string")
    lines = importance.distinct_lines(docs).collect()
    assert len(lines) == 41 and max(r.n for r in lines) == 40
    assert [len(r["keys"]) for r in importance.document_lines(docs).collect()] == [2] * 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ9é中 .\n" + "\x00\x7f", max_size=90), max_size=8))
def test_vectorised_buckets(texts):
    raw = [t.replace("\n", " ").encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    row, word, pair = importance.line_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        got = word[row == i].tolist() + pair[row == i][1:].tolist()
        assert got == features(t.replace("\n", " "))[1]
