"""Mixing to target weights with soft domain membership.

A softmax classifier, trained on a labelled table, gives each document a
posterior over domains, so a document counts towards every domain in part.  The
rates r >= 0 of the documents then minimise

    sum_d (sum_i r_i t_i p_id - T_d)^2 / T_d^2

with t_i the document's tokens and T_d the domain's target tokens, by projected
gradient descent in the metric that weighs a document by its tokens: a step
changes r_i by -step * sum_d p_id g_d, then projects it on r_i >= 0 (and on an
upper bound, where one is asked for).  A step needs only the D residuals, which
one aggregation over the documents gives; the step length comes from the D x D
moment matrix.  Nothing that grows with the documents reaches the driver.  The
steps taken are a short list, so a rate is a fold over p within the row and no
text is shuffled to be mixed.

Domains are fixed by the labelled table (few); the classifier is fitted on at
most ``sample_size`` labelled documents and ``sample_bytes`` of text, and
applied to whole texts, a very long one in fragments.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import cut, discard, drawn, fragments, letter_words, pieces, segment_sums, text_bytes, texts_of, unused

BUCKETS = 1 << 17
FRAGMENT = 1 << 20
DENSE = 6
MAX_DOMAINS = 64
#: Word scores of a document of n words are divided by n ** DAMPING.
DAMPING = 0.25
#: Domains that the labels table defines.
DOMAINS = ("clean", "junk", "toxic")
#: Shares of the mixture's tokens.
TARGET = {"clean": 0.90, "junk": 0.05, "toxic": 0.05}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    words: np.ndarray  # bucket x domain
    dense: np.ndarray  # DENSE x domain
    bias: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray):
    """Word buckets, first word of each row (and the end) and counts of each row: tokens, symbols, capitals, repeated words, exclamation marks, bars."""
    starts, _, hashes = letter_words(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    buckets = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    same = np.zeros(len(buckets), bool)
    same[1:] = buckets[1:] == buckets[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(same)]
    same[firsts] = False
    begins = ~_SPACE[data]
    begins[1:] &= _SPACE[data[:-1]]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = ~_SPACE[data[edges]]
    upper = (data >= 65) & (data <= 90)
    per_byte = [segment_sums(x.astype(np.float64), offsets) for x in (begins, _SYMBOL[data], upper, data == 33, data == 124)]
    return buckets, bounds, np.stack([*per_byte[:3], segment_sums(same.astype(np.float64), bounds), *per_byte[3:]], 1)


def ratios(found: np.ndarray, chars: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Dense features of each row from its counts, bytes and words."""
    chars, n_words = np.maximum(chars, 1), np.maximum(n_words, 1)
    tokens, symbols, capitals, same, marks, bars = found.T
    return np.stack([10 * symbols / chars, 5 * capitals / chars, 5 * same / n_words, 10 * marks / chars, np.log1p(tokens) / 5, 10 * bars / chars], 1)


def measures(data: np.ndarray, offsets: np.ndarray):
    """Word buckets, first word of each row (and the end), dense ratios and tokens of each row."""
    buckets, bounds, found = counts(data, offsets)
    return buckets, bounds, ratios(found, np.diff(offsets), np.diff(bounds)), found[:, 0]


def logits(buckets, bounds, dense, model: Classifier) -> np.ndarray:
    scale = np.maximum(np.diff(bounds), 1.0)[:, None] ** -DAMPING
    return segment_sums(model.words[buckets], bounds) * scale + dense @ model.dense + model.bias


def long_text_logits(data: np.ndarray, model: Classifier, size: int = FRAGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Logits (one row) and tokens of one text, read in fragments that end after white space."""
    total, found, n_words, last = np.zeros((1, len(model.domains))), np.zeros((1, 6)), 0, -1
    for a, b in fragments(data, size):
        buckets, bounds, own = counts(data[a:b], np.array([0, b - a]))
        total += segment_sums(model.words[buckets], bounds)
        if len(buckets):
            own[0, 3] += buckets[0] == last
            last = buckets[-1]
        found += own
        n_words += len(buckets)
    dense = ratios(found, np.array([len(data)]), np.array([n_words]))
    return total * max(n_words, 1.0) ** -DAMPING + dense @ model.dense + model.bias, found[:, 0]


def softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(domain: np.ndarray, domains: tuple[str, ...], buckets, times, bounds, dense, epochs: int = 150, rate: float = 0.05, decay: float = 1e-4, min_docs: int = 5) -> Classifier:
    """Softmax regression by Adam with a proximal step that keeps rare words at zero.

    A row has its distinct word buckets and how many ``times`` it holds each.
    One domain's sums are made at a time, so a step needs little more than the
    entries themselves.
    """
    k = len(domains)
    words, wide, bias = np.zeros((BUCKETS, k)), np.zeros((DENSE, k)), np.zeros(k)
    if not len(domain):
        return Classifier(domains, words, wide, bias)
    common = np.bincount(buckets, minlength=BUCKETS) >= min_docs
    used = common[buckets]
    # Only the words in use carry weights while training.
    columns = np.flatnonzero(common)
    own = (np.cumsum(common) - 1)[buckets[used]]
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(used)])[bounds]
    sizes = np.diff(starts)
    # Each entry's share in its row's score: its times by the row's damped number of words.
    share = times[used] * np.repeat(np.maximum(segment_sums(times, bounds), 1.0) ** -DAMPING, sizes)
    del used
    truth = np.eye(k)[domain]
    params = [np.zeros((len(columns), k)), wide, bias]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, epochs + 1):
        s = dense @ params[1] + params[2]
        for c in range(k):
            s[:, c] += segment_sums(params[0][:, c][own] * share, starts)
        g = (softmax(s) - truth) / len(domain)
        by_word = np.stack([np.bincount(own, np.repeat(g[:, c], sizes) * share, len(columns)) for c in range(k)], 1)
        for i, x in enumerate([by_word, dense.T @ g, g.sum(0)]):
            first[i] = 0.9 * first[i] + 0.1 * x
            second[i] = 0.98 * second[i] + 0.02 * x * x
            root = np.sqrt(second[i] / (1 - 0.98**step)) + 1e-7
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / root
            if i == 0:
                params[0] = np.sign(params[0]) * np.maximum(np.abs(params[0]) - rate * decay / root, 0)
    words[columns] = params[0]
    return Classifier(domains, words, params[1], params[2])


def train(sample: DataFrame, domains: tuple[str, ...], **options) -> Classifier:
    """Fit on rows (draw, doc_id, domain, text); rows of other domains teach nothing."""
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_bytes(part.column(3))
                buckets, bounds, dense, _ = measures(data, offsets)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                entries, times = np.unique(row * BUCKETS + buckets, return_counts=True)
                ends = pa.array(np.searchsorted(entries, np.arange(part.num_rows + 1) * BUCKETS).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (entries % BUCKETS, times)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists, pa.array(list(dense), pa.list_(pa.float64()))], ["draw", "doc_id", "domain", "words", "times", "dense"])

    known = sample.where(F.col("domain").isin(*domains)).select("draw", "doc_id", "domain", F.col("text").cast("string").alias("text"))
    table = known.mapInArrow(run, "draw long, doc_id long, domain string, words array<int>, times array<int>, dense array<double>").toArrow()
    table = table.sort_by([("draw", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    domain = np.array([domains.index(x) for x in table.column("domain").to_pylist()], np.int64)
    dense = np.array(table.column("dense").to_pylist(), np.float64).reshape(-1, DENSE)
    sizes = pc.list_value_length(table.column("words")).to_numpy().astype(np.int64)
    buckets, times = (pc.list_flatten(table.column(c)).to_numpy() for c in ("words", "times"))
    del table
    return fit(domain, domains, buckets, times, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), dense, **options)


def posteriors(docs: DataFrame, model: Classifier, n_tokens: str = "n_tokens", p: str = "p") -> DataFrame:
    """``docs`` with its tokens and its posterior over the model's domains, as two more columns.

    Tokens are runs of characters other than white space; null texts have none.
    Very long texts are read whole, in fragments.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in pieces(batch, "text"):
                data, offsets = text_bytes(part.column(at))
                if len(data) > 2 * FRAGMENT:  # a single row
                    s, tokens = long_text_logits(data, model)
                else:
                    buckets, bounds, dense, tokens = measures(data, offsets)
                    s = logits(buckets, bounds, dense, model)
                more = [pa.array(tokens.astype(np.int64)), pa.array(list(softmax(s)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, n_tokens, p])

    schema = StructType([*docs.schema.fields, StructField(n_tokens, LongType()), StructField(p, ArrayType(DoubleType()))])
    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rates:
    """Steps (momentum, pull of each domain) that lead from rate 1 to the fitted rates."""

    domains: tuple[str, ...]
    steps: tuple[tuple[float, tuple[float, ...]], ...]
    max_rate: float | None
    wanted: tuple[float, ...]
    reached: tuple[float, ...]

    def unmet(self, tolerance: float = 0.01) -> dict[str, float]:
        """Domains whose tokens miss their target by more than ``tolerance`` of it, with the share of it that is reached."""
        return {d: h / max(w, 1.0) for d, w, h in zip(self.domains, self.wanted, self.reached) if abs(h - w) > tolerance * max(w, 1.0)}

    def of(self, n_tokens: Column, p: Column) -> Column:
        """Rate of a row; 1 for a row without tokens, as no target depends on it."""
        one = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("last"))
        return _after(one, self.steps, n_tokens, p, self.max_rate)["rate"]


def _after(start: Column, steps, n_tokens: Column, p: Column, max_rate: float | None) -> Column:
    """(rate, last) after the steps: one short fold within the row."""
    if not steps:
        return start
    done = F.array(*[F.array(F.lit(float(m)), *[F.lit(float(x)) for x in g]) for m, g in steps])
    k = len(steps[0][1])

    def move(s: Column, h: Column) -> Column:
        ahead = s["rate"] + F.element_at(h, 1) * (s["rate"] - s["last"])
        pull = sum((F.element_at(p, i + 1) * F.element_at(h, i + 2) for i in range(k)), F.lit(0.0))
        rate = F.greatest(ahead - pull, F.lit(0.0))
        return F.struct((rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))).alias("rate"), s["rate"].alias("last"))

    return F.when(n_tokens > 0, F.aggregate(done, start, move)).otherwise(start)


def descend(
    table: DataFrame, domains: tuple[str, ...], target: dict[str, float], anchor: str | None = None, max_rate: float | None = None, rounds: int = 60, tolerance: float = 1e-3, every: int = 12
) -> Rates:
    """The rates that fit ``table`` (n_tokens, p) to the target.

    ``target`` holds the domains' shares of the mixture, whose size is that of
    all tokens at rate 1, or with an ``anchor`` domain a tenth more than that
    domain's tokens would call for (so at a maximum rate of 1 its documents are
    taken whole and the others give way).  Steps carry Nesterov's momentum,
    restarted when the residual grows.  Targets that stay out of reach are
    warned of and named by ``Rates.unmet``.
    """
    k = len(domains)
    p = [F.element_at("p", i + 1) for i in range(k)]
    t = F.col("n_tokens").cast("double")
    totals = table.agg(F.sum(t), *[F.sum(t * x) for x in p], *[F.sum(t * p[a] * p[b]) for a in range(k) for b in range(k)]).first()
    if not totals[0]:
        return Rates(domains, (), max_rate, (0.0,) * k, (0.0,) * k)
    size = float(totals[0])
    if anchor:
        size = 1.1 * float(totals[1 + domains.index(anchor)]) / target[anchor]
    wanted = np.array([target[d] for d in domains]) * size
    weight = 1 / np.maximum(wanted, 1.0)
    moment = np.array(totals[1 + k :], np.float64).reshape(k, k)
    step = 1 / np.linalg.eigvalsh(weight[:, None] * moment * weight[None, :]).max()
    state = table.select("n_tokens", "p", F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("last")).alias("s"))
    steps: list[tuple[float, tuple[float, ...]]] = []
    written = 0  # steps that the state holds
    momentum, speed, norm = 0.0, 1.0, np.inf

    for _ in range(rounds):
        now = state.select(t.alias("t"), "p", _after(F.col("s"), steps[written:], t, F.col("p"), max_rate).alias("s"))
        ahead = F.col("s.rate") + float(momentum) * (F.col("s.rate") - F.col("s.last"))
        have = np.array(now.agg(*[F.sum(F.col("t") * ahead * x) for x in p]).first(), np.float64)
        residual = (have - wanted) * weight
        if np.linalg.norm(residual) > norm:
            speed = 1.0
        gained, norm = norm - np.linalg.norm(residual), np.linalg.norm(residual)
        if norm < tolerance or 0 <= gained < tolerance * 1e-2:
            break
        steps.append((float(momentum), tuple(float(x) for x in step * residual * weight)))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        momentum, speed = (speed - 1) / faster, faster
        if len(steps) - written == every:
            spent, state = state, cut(state.select("n_tokens", "p", _after(F.col("s"), steps[written:], t, F.col("p"), max_rate).alias("s")))
            if written:
                discard(spent)
            written = len(steps)
    last = state.select(t.alias("t"), "p", _after(F.col("s"), steps[written:], t, F.col("p"), max_rate).alias("s"))
    have = last.agg(*[F.sum(F.col("t") * F.col("s.rate") * x) for x in p]).first()
    if written:
        discard(state)
    out = Rates(domains, tuple(steps), max_rate, tuple(wanted.tolist()), tuple(map(float, have)))
    if missed := out.unmet():
        warnings.warn(f"targets out of reach, shares reached: {missed}", stacklevel=2)
    return out


def fit_rates(table: DataFrame, domains: tuple[str, ...], target: dict[str, float], **options) -> DataFrame:
    """``table`` (n_tokens, p, ...) with a column ``rate``; see ``descend``.

    An empty table stays empty; documents without tokens keep rate 1.
    """
    return table.withColumn("rate", descend(table, domains, target, **options).of(F.col("n_tokens"), F.col("p")))


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a row of the labels table: toxic before junk before clean; null without labels."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "junk").when((quality == 1) | (toxic == 0), "clean")


def labelled_domains(docs: DataFrame, labels: DataFrame, sample_size: int, sample_bytes: int = 32 << 20) -> DataFrame:
    """(draw, doc_id, text, domain) of at most ``sample_size`` labelled documents and ``sample_bytes`` of text, the same on every run.

    Each domain has its share of the rows, and 200 where it has so many.
    """
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    known = named.select("doc_id", domain_of(F.col("q"), F.col("x")).alias("domain")).where("domain is not null")
    return texts_of(docs, drawn(known, sample_size, 3, by="domain"), sample_bytes)


def classifier(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], sample_size: int) -> Classifier:
    return train(labelled_domains(docs, labels, sample_size), domains)


def mixing_rates(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, sample_size: int = 6000, **options) -> DataFrame:
    """(doc_id, n_tokens, p, rate) for every row of ``docs``.

    Null texts have no tokens and keep rate 1.  Repeated rows get equal rates.
    Columns besides doc_id and text are not read.  Rates have no upper bound
    unless ``max_rate`` sets one.
    """
    target = target or TARGET
    domains = tuple(target)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = cut(posteriors(rows, classifier(docs, labels, domains, sample_size)).drop("text"))
    return fit_rates(table, domains, target, **options)


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, max_rate: float | None = 1.0, anchor: str | None = "clean", sample_size: int = 6000, **options) -> DataFrame:
    """The mixture: each row as many times as its rate says, with the columns of ``docs``.

    A rate's whole part gives copies; its fraction gives one more where a hash
    of the id and text falls below it, so the mixture is the same on every run.
    At a ``max_rate`` of 1 the mixture takes each document once or not.  Null
    texts keep rate 1; repeated rows are taken alike.  Rates are computed within
    the row, so no text is moved.
    """
    target = target or TARGET
    domains = tuple(target)
    n_tokens, p, copy = unused(docs, "n_tokens", "p", "rated_copy")
    texts = docs.withColumn("text", F.col("text").cast("string"))
    model = classifier(docs, labels, domains, sample_size)
    slim = cut(posteriors(texts.select("text"), model).drop("text"))
    rates = descend(slim, domains, target, anchor=anchor, max_rate=max_rate, **options)
    discard(slim)
    table = posteriors(texts, model, n_tokens, p)
    rate = rates.of(F.col(n_tokens), F.col(p))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(29)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    copies = F.floor(rate + chance).cast("int")
    if max_rate is not None and max_rate <= 1:
        return table.where(copies > 0).select(*docs.columns)
    counted = table.withColumn(copy, copies).where(F.col(copy) > 0)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = mixing_rates(docs, labels)
    return rated.select("doc_id", "n_tokens", *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGET)], "rate")
