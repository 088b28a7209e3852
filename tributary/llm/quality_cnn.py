"""Document quality by a byte-level convolutional network in numpy.

Every byte is embedded, together with a mark where its four-byte gram also
stands 3 to 24 bytes earlier (so that repetition is visible to short filters).
Learned filters run over the whole document; their responses are max-pooled in
chunks whose windows overlap by the filter width, and the chunks' pooled
activations (their mean and their maximum) are combined into one probability.

As a filter sees a byte through a table of 512 entries, a convolution is
``WIDTH`` table look-ups for each byte.  The network is fitted on at most
``sample_size`` labelled documents and ``sample_bytes`` of text, read whole;
scoring works on pieces of bounded size, a long text's chunks in turns, and
gives a text the same score whatever its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, text_bytes
from .toxicity_mil import labelled_sample

WIDTH, FILTERS, EMBED, CHUNK = 6, 12, 6, 512
LAGS = range(3, 25)
GAP = 32  # bytes between documents; 0xFF, which UTF-8 never holds
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # 512 x EMBED, the upper half for marked bytes
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    shift: np.ndarray  # FILTERS
    head: np.ndarray  # 2 * FILTERS
    bias: float

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes with gaps between documents, and where each document begins."""
    lengths = np.diff(offsets)
    begins = offsets[:-1] + GAP * np.arange(1, len(lengths) + 1)
    out = np.full(int(offsets[-1]) + GAP * (len(lengths) + 1), 0xFF, np.uint8)
    out[np.arange(len(data)) + GAP * np.repeat(np.arange(1, len(lengths) + 1), lengths)] = data
    grams = out[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        grams |= out[k : len(out) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    marked = np.zeros(len(grams), bool)
    for lag in LAGS:
        marked[lag:] |= grams[lag:] == grams[:-lag]
    codes = out.astype(np.int64)
    inside = np.flatnonzero(marked)
    inside = inside[out[inside] != 0xFF]
    codes[inside] += 256
    return codes, begins


def chunks(begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each chunk (one at least for a document) and each document's first chunk (and the end)."""
    stride = CHUNK - WIDTH + 1
    sizes = np.maximum(lengths, 1)
    per_row = -(-sizes // stride)
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(lengths)), per_row)
    start = begins[row] + stride * (np.arange(first[-1]) - first[row])
    return start, np.minimum(start + stride, (begins + sizes)[row]), first


def responses(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    n = len(codes) - WIDTH + 1
    out = np.take(tables[0], codes[:n], axis=0)
    for k in range(1, WIDTH):
        out += np.take(tables[k], codes[k : k + n], axis=0)
    return out


def pooled(out: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximum response of each filter in each chunk."""
    edges = np.stack([start, end], 1).ravel()
    return np.maximum.reduceat(out, edges, axis=0)[::2]


def combine(net: Network, top: np.ndarray, first: np.ndarray):
    """Probability of each document from its chunks' pooled responses, and the parts training needs."""
    active = np.maximum(top + net.shift, 0).astype(np.float64)
    mean = np.add.reduceat(active, first[:-1], axis=0) / np.diff(first)[:, None]
    most = np.maximum.reduceat(active, first[:-1], axis=0)
    features = np.concatenate([mean, most], 1)
    # Summed row by row, so that a document's score doesn't depend on the others.
    return 1 / (1 + np.exp(-np.clip((features * net.head).sum(1) + net.bias, -30, 30))), features, active


def fit(texts: pa.Array, label: np.ndarray, epochs: int = 14, batch_bytes: int = 150_000, updates: int = 600, rate: float = 0.01, seed: int = 5) -> Network:
    """Train by Adam on the log loss; gradients reach each filter through the windows that won its chunks.

    Small samples take more than ``epochs`` passes, for about ``updates`` steps.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (512, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0
    )
    if not len(label) or label.min() == label.max():
        net.head[:] = 0
        net.bias = 0.0 if not len(label) else (4.0 if label[0] else -4.0)
        return net
    data, offsets = text_bytes(texts)
    lengths = np.diff(offsets)
    state = {k: [0.0, 0.0] for k in ("embed", "filters", "shift", "head", "bias")}
    step = 0
    batches = -(-int(lengths.sum() + GAP * len(lengths)) // batch_bytes)
    if epochs > 1:
        epochs = max(epochs, min(150, -(-updates // batches)))
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        groups = np.cumsum(lengths[order] + GAP) // batch_bytes
        for group in np.split(order, np.flatnonzero(np.diff(groups)) + 1):
            own = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in group])
            at = np.concatenate([[0], np.cumsum(lengths[group])])
            codes, begins = layout(own, at)
            start, end, first = chunks(begins, lengths[group])
            out = responses(codes, net.tables())
            where = np.stack([out[a:b].argmax(0) + a for a, b in zip(start, end)])
            top = out[where, np.arange(FILTERS)]
            p, features, active = combine(net, top, first)
            slope = (p - label[group]) / len(group)
            to_features = slope[:, None] * net.head
            row = np.repeat(np.arange(len(group)), np.diff(first))
            back = to_features[row, :FILTERS] / np.diff(first)[row, None]
            back = back + to_features[row, FILTERS:] * (active == features[row, FILTERS:])
            back = back * (active > 0)
            windows = codes[where[..., None] + np.arange(WIDTH)]
            to_embed = np.zeros_like(net.embed)
            spread = back[..., None, None] * net.filters.transpose(2, 0, 1)
            for e in range(EMBED):
                to_embed[:, e] = np.bincount(windows.ravel(), spread[..., e].ravel(), 512)
            gradient = {
                "embed": to_embed,
                "filters": np.einsum("cf,cfwe->wef", back, net.embed[windows], optimize=True),
                "shift": back.sum(0),
                "head": features.T @ slope + 1e-4 * net.head,
                "bias": slope.sum(),
            }
            step += 1
            for name, g in gradient.items():
                m = state[name]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                move = rate * (1 - 0.9 * epoch / epochs) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - move)
    return net


def train(sample: DataFrame, **options) -> Network:
    """Fit on (draw, doc_id, label, text) rows; null texts count as empty."""
    rows = sample.select("draw", "doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).toArrow()
    if not rows.num_rows:
        return fit(pa.array([], pa.string()), np.zeros(0), **options)
    rows = rows.sort_by([("draw", "ascending"), ("doc_id", "ascending")])
    return fit(rows.column("text").cast(pa.large_string()).combine_chunks(), rows.column("label").to_numpy().astype(np.float64), **options)


def long_text_tops(data: np.ndarray, tables: np.ndarray, turn: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pooled responses of one text's chunks and its first chunk (and the end), ``turn`` chunks at a time.

    A turn reads the bytes before it that marks look back on and those after
    it that its last windows need.
    """
    stride = CHUNK - WIDTH + 1
    back, tops = max(LAGS) + 4, []
    for at in range(0, len(data), turn * stride):
        stop = min(len(data), at + turn * stride)
        low, high = max(0, at - back), min(len(data), stop + back)
        codes, begins = layout(data[low:high], np.array([0, high - low]))
        start, end, _ = chunks(begins + at - low, np.array([stop - at]))
        tops.append(pooled(responses(codes, tables), start, end))
    return np.concatenate(tops), np.array([0, sum(map(len, tops))])


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for every row; null texts score as empty ones.

    Very long texts are read whole, in turns of bounded size.  Repeated rows
    stay repeated; columns besides doc_id and text are not read.
    """
    tables, most = net.tables(), 1 << 18

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", most):
                data, offsets = text_bytes(part.column(1))
                if len(data) > most:  # a single row
                    top, first = long_text_tops(data, tables)
                else:
                    codes, begins = layout(data, offsets)
                    start, end, first = chunks(begins, np.diff(offsets))
                    top = pooled(responses(codes, tables), start, end)
                p, _, _ = combine(net, top, first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_quality_cnn(spark, sf_dir: str, sample_size: int = 2500) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_out(F.col("doc_id"), 5, 0)
    net = train(labelled_sample(docs, labels.where(~held), "quality", sample_size))
    scored = score_documents(docs, net)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
