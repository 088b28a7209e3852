"""The pipeline's near-duplicate stage against the Jaccard similarity of all pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import shingle_join
from tributary.llm.common import among

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Smallest id of each component of the pairs with similarity 0.8 or more, and the number of such pairs of different sets."""
    sets = {i: plain_shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
            near += x != y
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i for i in sets if find(i) == i}, near


def stage(spark, rows):
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    return sorted(r.doc_id for r in out.collect())


def test_stage_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, near = survivors(rows)
    assert near >= 10
    assert stage(spark, rows) == sorted(want)


def test_stage_at_the_threshold(spark):
    """Edits that leave 0.8 or a little less, chains, short and blank texts."""
    words = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:40]) + " end"), (3, " ".join(words[5:]) + " x y z"), (4, "\n".join(words[:41]).upper())]
    rows += [(10, "only four words here"), (11, "Only  four\twords here"), (12, "only four words"), (20, None), (21, ""), (22, " \n")]
    rows += [(30 + i, " ".join(f"k{j}" for j in range(3 * i, 3 * i + 60))) for i in range(12)]
    want, near = survivors(rows)
    assert near >= 12 and len(want) < len(rows) - 12
    assert stage(spark, rows) == sorted(want)


def test_texts_of_unlike_long_candidates_are_not_read(spark, monkeypatch):
    """Long texts with half of their shingles in common share rare ones; their parities tell before the texts are fetched."""
    rng = random.Random(3)
    words = [[f"{c}{rng.random()}" for _ in range(900)] for c in "abcdefgh"]
    common = [f"z{rng.random()}" for _ in range(1800)]
    rows = [(i, " ".join(common + w)) for i, w in enumerate(words)]
    rows += [(20, " ".join(common + words[0][:-20])), (21, "short"), (22, None)]
    fetched, cut = [], shingle_join.cut

    def counted(df):
        out = cut(df)
        fetched.append(out.count() if "text" in df.columns else 0)
        return out

    monkeypatch.setattr(shingle_join, "cut", counted)
    want, near = survivors(rows)
    assert near == 1
    assert stage(spark, rows) == sorted(want)
    assert max(fetched) == 2


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 1 << 56, 3000)) for _ in range(2))
    b = np.unique(np.concatenate([b[:500], a[:2500]]))
    row, key = np.repeat([0, 1, 2], [len(a), len(b), 5]), np.concatenate([a, b, a[:5]])
    n = np.bincount(row)
    wide = shingle_join.wide_parities(row, key, n).to_pylist()
    unlike = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(wide[0], wide[1]))
    assert 500 < unlike <= len(np.setxor1d(a, b)) and wide[2] == []


def test_among_keeps_all_wanted_and_few_others(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") * 7).alias("marks"))
    wanted = spark.range(0, 20_000, 50).select(F.col("id").alias("k"), (F.col("id") * 7).alias("m"))
    got = {tuple(r) for r in among(rows, ["doc_id", "marks"], wanted, ["k", "m"]).collect()}
    want = {tuple(r) for r in wanted.collect()}
    assert want <= got and len(got) < 1000
    assert among(rows, ["doc_id"], wanted.limit(0), ["k"]).count() == 0
    assert {i for i, _ in want} <= {r.doc_id for r in among(rows, ["doc_id"], wanted, ["k"], most_bits=1 << 15).collect()}


def test_candidates_of_near_copies_grow_with_the_group(spark, monkeypatch):
    """Copies with one to four edited words, most of which only the least edited resemble, are few candidates each."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 4)):
            words[at] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    candidates, verified = [], shingle_join.verified

    def counted(docs, classes, found, *options):
        candidates.append(found.distinct().count())
        return verified(docs, classes, found, *options)

    monkeypatch.setattr(shingle_join, "verified", counted)
    want, near = survivors(rows)
    assert near > 20 * len(rows)
    assert stage(spark, rows) == sorted(want)
    assert sum(candidates) < 3 * len(rows), candidates
