"""Document toxicity by multiple-instance learning over sentences.

Only documents are labelled.  A sentence's score is a logistic of its words
(each with its first four and six bytes, so that inflected and compound forms
count alike); a document is toxic unless every sentence is clean, so its score is the noisy-or
of its sentences, and the labels' likelihood trains the sentence model.  The
same scores then locate the offending sentences.

The model is fitted on at most ``sample_size`` labelled documents and
``sample_bytes`` of text, drawn by a hash of their id; scoring reads every
document whole, in vectorised pieces of bounded size: a long text's sentences
are summed fragment by fragment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drawn, fragments, held_out, letter_words, pieces, segment_sums, span_hashes, text_bytes, texts_of

BUCKETS = 1 << 18
FRAGMENT = 1 << 20
THRESHOLD = 0.7
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one for each word bucket
    bias: float


#: Beginnings of words, in bytes, that are features beside the word itself.
PREFIXES = (4, 6)
FEATURES = 1 + len(PREFIXES)


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Buckets of the words' features (``FEATURES`` in a row for each word), first word of each sentence (and the end), first sentence of each row (and the end)."""
    starts, ends, hashes = letter_words(data, offsets)
    low = LOWER[data]
    kinds = [hashes]
    for k, n in enumerate(PREFIXES, 1):
        kinds.append(span_hashes(low, starts, np.minimum(ends, starts + n)) ^ np.uint64(0x9E37 * k))
    buckets = (np.stack(kinds, 1).ravel() & np.uint64(BUCKETS - 1)).astype(np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.cumsum(_END[data]) if len(data) else np.zeros(0, np.int64)
    mark = stops[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    per_row = np.searchsorted(row[first], np.arange(len(offsets)), side="left")
    return buckets, np.append(first, len(starts)), per_row, starts, ends


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentence_scores(buckets: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    return sigmoid(segment_sums(model.weights[buckets], bounds * FEATURES) + model.bias)


def long_text_sentences(data: np.ndarray, model: Model, size: int = FRAGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, first byte and last byte (exclusive) of each sentence of one text, read in fragments.

    A sentence that goes on in the next fragment adds up its words' weights.
    """
    mark, total, first, last = [], [], [], []
    stops = 0
    for a, b in fragments(data, size):
        own = data[a:b]
        buckets, bounds, _, starts, ends = sentences(own, np.array([0, len(own)]))
        if len(starts):
            mark.append(stops + np.cumsum(_END[own])[starts[bounds[:-1]]])
            total.append(segment_sums(model.weights[buckets], bounds * FEATURES))
            first.append(a + starts[bounds[:-1]])
            last.append(a + ends[bounds[1:] - 1])
        stops += int(_END[own].sum())
    if not mark:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark, total, first, last = (np.concatenate(x) for x in (mark, total, first, last))
    head = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
    return sigmoid(np.add.reduceat(total, head) + model.bias), first[head], last[np.append(head[1:], len(mark)) - 1]


def noisy_or(scores: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """1 - prod(1 - score) over each row's sentences; a row without words scores 0."""
    return -np.expm1(segment_sums(np.log1p(-np.minimum(scores, 1 - 1e-9)), per_row))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample_size: int, sample_bytes: int = 32 << 20) -> DataFrame:
    """(draw, doc_id, text, label) of at most ``sample_size`` labelled documents and ``sample_bytes`` of text.

    Each label has its share of the rows, and 200 where it has so many; the
    draw is the same on every run.  Labels with a null id or value are left
    out; of clashing labels the greatest counts for toxicity and the least for
    quality.
    """
    worst = F.min if column == "quality" else F.max
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(worst(column).cast("int").alias("label"))
    return texts_of(docs, drawn(known, sample_size, 42, by="label"), sample_bytes)


def train(sample: DataFrame, **options) -> Model:
    """Fit the sentence model on (draw, doc_id, label, text) rows; see ``fit``."""

    def hashed(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_bytes(part.column(3))
                buckets, bounds, per_row, _, _ = sentences(data, offsets)
                words, lengths = [], []
                for i in range(part.num_rows):
                    a, b = per_row[i], per_row[i + 1]
                    words.append(buckets[bounds[a] * FEATURES : bounds[b] * FEATURES])
                    lengths.append(np.diff(bounds[a : b + 1]) * FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(words, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))], ["draw", "doc_id", "label", "words", "lengths"]
                )

    rows = sample.select("draw", "doc_id", "label", "text").mapInArrow(hashed, "draw long, doc_id long, label int, words array<int>, lengths array<int>").toArrow()
    rows = rows.sort_by([("draw", "ascending"), ("doc_id", "ascending")])
    label = rows.column("label").to_numpy().astype(np.float64)
    words = rows.column("words").combine_chunks()
    lengths = rows.column("lengths").combine_chunks()
    buckets = words.flatten().to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy().astype(np.int64))])
    per_row = np.concatenate([[0], np.cumsum(np.array([len(x) for x in lengths], np.int64))]).astype(np.int64)
    return fit(label, buckets, bounds, per_row, **options)


def fit(label, buckets, bounds, per_row, epochs: int = 250, rate: float = 0.2, decay: float = 1e-3, min_docs: int = 4, start_bias: float = -6.0, leak: float = 0.03) -> Model:
    """Maximise the likelihood of the documents' labels under the noisy-or.

    A label is taken to be wrong with probability ``leak``, so documents marked
    toxic for no visible reason don't teach innocent words.
    ``bounds`` are the sentences' first features and ``per_row`` the rows' first
    sentences.  Words of fewer than ``min_docs`` documents teach nothing.  The
    penalty falls as chance does, with the square root of the documents.
    Without both labels every word keeps weight zero.
    """
    weights, bias = np.zeros(BUCKETS), start_bias
    if not len(label) or label.min() == label.max() or not len(buckets):
        return Model(weights.astype(np.float32), bias)
    of_sentence = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    of_row = np.repeat(np.arange(len(label)), np.diff(per_row))
    pairs = np.unique(of_row[of_sentence] * BUCKETS + buckets)
    common = np.bincount(pairs % BUCKETS, minlength=BUCKETS) >= min_docs
    used = common[buckets]
    buckets, of_sentence = buckets[used], of_sentence[used]
    bounds = np.searchsorted(of_sentence, np.arange(len(bounds)))
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(segment_sums(weights[buckets], bounds) + bias, -30, 30)))
        whole = noisy_or(p, per_row)
        seen = leak + (1 - 2 * leak) * whole
        pull = (1 - 2 * leak) * (1 - whole) * np.where(label == 1, -1 / np.maximum(seen, 1e-9), 1 / np.maximum(1 - seen, 1e-9))
        slope = p * pull[of_row] / len(label)
        gradient = np.append(np.bincount(buckets, slope[of_sentence], BUCKETS), slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.98 * second + 0.02 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-7)
        weights -= move[:-1]
        # A proximal step keeps words without steady evidence at zero.
        scale = rate * decay / np.sqrt(len(label)) / (np.sqrt(second[:-1] / (1 - 0.98**step)) + 1e-7)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale, 0)
        bias -= move[-1]
    weights[~common] = 0
    return Model(weights.astype(np.float32), float(bias))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_offending) for every row; null, empty and wordless texts score 0.

    Very long texts are read in fragments, whole.  A text has the same score
    whatever its neighbours; repeated rows stay repeated; other columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                if len(data) > 2 * FRAGMENT:  # a single row
                    p = long_text_sentences(data, model)[0]
                    per_row = np.array([0, len(p)])
                else:
                    buckets, bounds, per_row, _, _ = sentences(data, offsets)
                    p = sentence_scores(buckets, bounds, model)
                bad = segment_sums((p >= 0.5).astype(np.float64), per_row).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(noisy_or(p, per_row), 0, 1)), pa.array(bad)], ["doc_id", "score", "n_offending"])

    return _rows(docs).mapInArrow(run, "doc_id long, score double, n_offending long")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of every offending sentence, in code points from its first to its last word.

    Texts without one, null and empty texts give no row; repeated rows give
    theirs again; very long texts are read in fragments.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                if len(data) > 2 * FRAGMENT:
                    p, first, last = long_text_sentences(data, model)
                    per_row = np.array([0, len(p)])
                else:
                    buckets, bounds, per_row, starts, ends = sentences(data, offsets)
                    p = sentence_scores(buckets, bounds, model)
                    first, last = starts[bounds[:-1]], ends[bounds[1:] - 1]
                hit = np.flatnonzero(p >= least)
                row = np.searchsorted(per_row, hit, side="right") - 1
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                origin = point[offsets[row]]
                ids = part.column(0).take(pa.array(row))
                a, b = point[first[hit]] - origin, point[last[hit]] - origin
                yield pa.RecordBatch.from_arrays([ids, pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(p[hit])], ["doc_id", "start", "end", "score"])

    return _rows(docs).mapInArrow(run, "doc_id long, start long, end long, score double")


def op7_toxicity(spark, sf_dir: str, sample_size: int = 5000) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_out(F.col("doc_id"), 3, 1)
    model = train(labelled_sample(docs, labels.where(~held), "toxic", sample_size))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending")
