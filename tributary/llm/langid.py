"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams.  Document frequencies
come from one pass over every document of the training fold; the regression is
trained with follow-the-regularised-leader (FTRL-proximal) under an elastic-net
penalty on at most ``sample_size`` documents and ``sample_bytes`` of text, in
which every language has some, and one temperature is fitted on documents of
the sample that training set aside.  Scoring is a table look-up for each
n-gram, so documents are read whole in vectorised pieces, a long one in
fragments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, held_out, pieces, segment_sums, text_bytes, texts_of

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
UNKNOWN = "und"
_TABLE = 0x250
FRAGMENT = 1 << 20


def _folded() -> np.ndarray:
    """Code points below U+0250: letters lower-cased, all else a space."""
    out = np.full(_TABLE, 32, np.uint32)
    for c in range(_TABLE):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD = _folded()


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # bucket x language: inverse document frequency times weight
    bias: np.ndarray
    temperature: float


def code_points(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows end to end, and each row's offset."""
    return folded_points(*text_bytes(part.column(column)))


def folded_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    low = points < _TABLE
    folded = points.copy()
    folded[low] = _FOLD[points[low]]
    return folded, starts[offsets]


def ngrams(part: pa.RecordBatch, column: int):
    """For rows of a batch in turn: (row, buckets of its n-grams).

    A long row comes in fragments that overlap by the longest n-gram but one
    character; n-grams that start in the overlap count in the next fragment.
    """
    data, offsets = text_bytes(part.column(column))
    if len(data) <= 2 * FRAGMENT:
        points, bounds = folded_points(data, offsets)
        grams = [ngram_buckets(points, bounds, order) for order in ORDERS]
        for i in range(part.num_rows):
            yield i, np.concatenate([h[b[i] : b[i + 1]] for h, b in grams])
        return
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    for at in range(0, len(begins), FRAGMENT):
        stop, most = at + FRAGMENT, at + FRAGMENT + max(ORDERS) - 1
        own = data[begins[at] : begins[most] if most < len(begins) else len(data)]
        points, _ = folded_points(own, np.array([0, len(own)]))
        grams = [ngram_buckets(points, np.array([0, len(points)]), order)[0] for order in ORDERS]
        yield 0, np.concatenate([g[: stop - at] for g in grams])


def ngram_buckets(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each place, and where each row's n-grams begin.

    Rows are padded to their neighbours: an n-gram that would cross a row's end
    is left out, so a row of n characters has n - order + 1 of them.
    """
    n = len(points)
    h = np.full(max(0, n - order + 1), 0x811C9DC5 + order, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ points[k : n - order + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
    keep = np.ones(len(h), bool)
    for k in range(1, order):
        edges = offsets[1:-1] - k
        keep[edges[(edges >= 0) & (edges < len(h))]] = False
    bounds = np.concatenate([[0], np.cumsum(keep)])[np.minimum(offsets, len(h))]
    return (h[keep] & np.uint32(BUCKETS - 1)).astype(np.int64), bounds


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents counted, over all rows of ``docs``."""

    def run(batches):
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                own, at = np.zeros(BUCKETS, bool), 0
                for i, found in ngrams(part, 0):
                    if i != at:
                        seen += own
                        own, at = np.zeros(BUCKETS, bool), i
                    own[found] = True
                seen += own
                rows += part.num_rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], rows))], ["bucket", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def ftrl(features: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, alpha: float, l1: float, l2: float, passes: int):
    """Multinomial FTRL-proximal over sparse rows (indices, values); returns weights and bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(3)

    def weights(rows):
        a = z[rows]
        # The bias (last row) carries no penalty.
        cut = np.where(rows == BUCKETS, 0.0, l1)[:, None]
        w = -(a - np.sign(a) * cut) / ((1.0 + np.sqrt(n[rows])) / alpha + l2)
        return np.where(np.abs(a) <= cut, 0.0, w)

    for _ in range(passes):
        for i in order.permutation(len(label)):
            rows, x = features[i]
            w = weights(rows)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    full = weights(np.arange(BUCKETS + 1))
    return full[:-1], full[-1]


def temperature_of(scores: np.ndarray, label: np.ndarray) -> float:
    """Temperature with the least negative log likelihood, by golden-section search of its logarithm."""
    if not len(label):
        return 1.0

    def loss(t):
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(label)), label]))

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, sample_size: int = 4000, alpha: float = 3.0, l1: float = 0.01, l2: float = 0.001, steps: int = 8000, sample_bytes: int = 32 << 20) -> Model:
    """Fit on rows (doc_id, text, lang); rows with a null text or lang teach nothing.

    ``docs`` is the whole training fold: document frequencies read all of it.
    The weights are fitted on a sample in which each language has its share,
    and 200 documents where it has so many; of a repeated id the least language
    counts.
    """
    known = docs.where("lang is not null and text is not null")
    seen, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + seen)) + 1
    named = known.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("lang").alias("lang"))

    def sparse(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                counts = [np.zeros(BUCKETS, np.int64) for _ in range(part.num_rows)] if part.num_rows == 1 else {}
                rows, values = [None] * part.num_rows, [None] * part.num_rows
                for i, found in ngrams(part, 3):
                    own = np.bincount(found, minlength=BUCKETS)
                    if part.num_rows == 1:
                        own = counts[0] = counts[0] + own
                    at = np.flatnonzero(own)
                    rows[i], values[i] = at, own[at] / max(1, own.sum())
                empty = np.zeros(0)
                rows, values = ([empty if x is None else x for x in y] for y in (rows, values))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rows, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["draw", "doc_id", "lang", "rows", "tf"])

    sample = texts_of(known.select("doc_id", "text"), drawn(named, sample_size, 11, by="lang"), sample_bytes).select("draw", "doc_id", "lang", "text")
    table = sample.mapInArrow(sparse, "draw long, doc_id long, lang string, rows array<int>, tf array<float>").toArrow().sort_by([("draw", "ascending"), ("doc_id", "ascending")])
    names = table.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    label = np.array([languages.index(x) for x in names])
    features = []
    for at, tf in zip(table.column("rows"), table.column("tf")):
        at, tf = at.values.to_numpy().astype(np.int64), tf.values.to_numpy().astype(np.float64)
        features.append((np.append(at, BUCKETS), np.append(tf * idf[at], 1.0)))
    aside = np.arange(len(label)) % 5 == 4
    fit = np.flatnonzero(~aside)
    passes = max(2, -(-steps // max(1, len(fit))))  # small samples are seen more often
    weights, bias = ftrl([features[i] for i in fit], label[fit], len(languages), alpha, l1, l2, passes)
    held = np.flatnonzero(aside)
    scores = np.array([x[:-1] @ weights[at[:-1]] + bias for at, x in (features[i] for i in held)]).reshape(len(held), len(languages))
    return Model(languages, idf[:, None] * weights, bias, temperature_of(scores, label[held]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    Texts that are null or hold no letter, and all texts where nothing was
    learned, are ``und`` with score 0; ties go to the first language in
    alphabetical order.  Very long texts are read whole, in fragments.  Repeated
    rows stay repeated; other columns are not read.
    """
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        table = np.ascontiguousarray(model.table)
        for batch in batches:
            for part in pieces(batch, "text"):
                lettered = np.array(part.column(2).to_pylist(), bool) if part.num_rows else np.zeros(0, bool)
                if not model.languages:
                    best, score = np.full(part.num_rows, 0), np.zeros(part.num_rows)
                    lettered[:] = False
                else:
                    data, offsets = text_bytes(part.column(1))
                    total, count = np.zeros((part.num_rows, len(model.languages))), np.zeros(part.num_rows)
                    if len(data) > 2 * FRAGMENT:  # a single row
                        for _, found in ngrams(part, 1):
                            total[0] += table[found].sum(0)
                            count[0] += len(found)
                    else:
                        points, offsets = folded_points(data, offsets)
                        for order in ORDERS:
                            h, bounds = ngram_buckets(points, offsets, order)
                            for c in range(len(model.languages)):
                                total[:, c] += segment_sums(table[:, c][h], bounds)
                            count += np.diff(bounds)
                    s = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    score = p[np.arange(len(p)), best]
                named = names[np.where(lettered, best, len(model.languages))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_langid(spark, sf_dir: str, sample_size: int = 4000) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~held).select("doc_id", "text", "lang"), sample_size)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
