"""Audit of how far the sources of a language diverge in their words.

One pass counts each group's terms, by documents and by occurrences.  Per lang,
MLlib's CountVectorizer turns each group's bags into exact sparse vectors over all
terms in at least minDF of the lang's documents (no vocabSize cuts them), which
feed an exact evaluation of all source pairs that touches stored entries alone.

A vectorizer's vocabulary goes through the driver.  A fit on the texts would
bring it there whatever its size, so document frequencies are counted first and
the vectorizers are fitted on the frequent terms alone: as many as keep each
below ``VOCABULARY`` terms.  One vectorizer serves all langs; a lang's vocabulary
is the set of its indices, and sums at other indices are none of its.

Sparse pairs.  With f(p, q) the divergence of one term and p0 the value of a
group for a term it lacks, the sum over all V terms is H(a, b) + H(b, a)
- V f(p0a, p0b) + the terms in both of f(pa, pb) - f(pa, p0b) - f(p0a, pb)
+ f(p0a, p0b).  H(a, b), all terms of a against b's p0, needs a's distinct
values and how often each occurs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LETTER, LOWER, cut, pieces, text_bytes

#: Most terms in one vectorizer's vocabulary.
VOCABULARY = 1_000_000
#: Most groups that are broadcast to number the documents' groups; beyond, sums are keyed by the names.
GROUPS = 100_000
MIN_DF = 10
TOP_TERMS = 10
SALT = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z lower-cased, and bytes that end a term as spaces.
_TERM = np.where(LETTER, LOWER, 32).astype(np.uint8)
_ENDS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def bags(docs: DataFrame) -> DataFrame:
    """(lang, source, terms) of every document, nulls read as empty.

    Terms are runs of ASCII letters and other code points, only A-Z lower-cased
    (``lower`` does no more to texts of ASCII alone, and is faster).
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    small = F.when(F.char_length("text") == F.octet_length("text"), F.lower("text")).otherwise(F.translate("text", _UPPER, _UPPER.lower()))
    return read.select("lang", "source", F.array_remove(F.split(small, _ENDS), "").alias("terms"))


def document_counts(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(*keys, term, n, occurrences): documents that hold a term, and how often they do, within some of a task's documents.

    The terms are those of ``bags``.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                data, offsets = text_bytes(part.column(len(keys)))
                texts = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(_TERM[data])])
                split = pc.split_pattern(texts, b" ")
                found, group = split.values.dictionary_encode(), np.zeros(part.num_rows, np.int64)
                for column in part.columns[: len(keys)]:
                    named = column.dictionary_encode()
                    group = group * len(named.dictionary) + np.asarray(named.indices)
                _, first, group = np.unique(group, return_index=True, return_inverse=True)
                terms, size = found.dictionary, max(1, len(found.dictionary))
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(split.offsets)))
                held, times = np.unique(row * size + np.asarray(found.indices), return_counts=True)
                held = group[held // size] * size + held % size
                order = np.argsort(held, kind="stable")
                held, times = held[order], times[order]
                starts = np.flatnonzero(np.diff(held, prepend=-1))
                own, n = held[starts], np.diff(starts, append=len(held))
                occurrences = np.add.reduceat(times, starts) if len(starts) else times
                filled = pc.binary_length(terms).to_numpy()[own % size] > 0
                own, n, occurrences = own[filled], n[filled], occurrences[filled]
                at = pa.array(first[own // size])
                term = terms.take(pa.array(own % size)).cast(pa.binary()).view(pa.string())
                values = [*[c.take(at) for c in part.columns[: len(keys)]], term, pa.array(n.astype(np.int64)), pa.array(occurrences.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(values, [*keys, "term", "n", "occurrences"])

    kinds = "number long" if keys == ("number",) else ", ".join(f"{k} string" for k in keys)
    read = [F.col(k) if k == "number" else F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(*read, text).mapInArrow(run, f"{kinds}, term string, n long, occurrences long")


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)


def term_counts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, documents, n) of each group's terms: documents that hold it and its occurrences, written once.

    Where the groups are few their numbers are the keys, which are cheaper than names.
    """
    few = groups.count() <= GROUPS
    keys, read = ("lang", "source"), docs
    if few:
        names = sorted((r.lang, r.source) for r in groups.collect())
        numbers = docs.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(names)], "lang string, source string, number long")
        named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
        keys, read = ("number",), named.join(F.broadcast(numbers), ["lang", "source"]).select("number", "text")
    counted = cut(document_counts(read, keys).groupBy(*keys, "term").agg(F.sum("n").alias("documents"), F.sum("occurrences").alias("n")))
    return (counted.join(F.broadcast(numbers), "number") if few else counted).select("lang", "source", "term", "documents", "n")


def group_counts(docs: DataFrame, min_df: int = MIN_DF, vocabulary: int = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (lang, source); kept terms (lang, shard, index, term); occurrences (lang, source, shard, index, n).

    A term is kept where ``min_df`` documents of its lang hold it.  Every
    occurring group is returned, with terms or not.  Repeated rows are
    documents of their own.
    """
    spark = docs.sparkSession
    groups = cut(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct())
    held = term_counts(docs, groups)
    frequent = held.groupBy("lang", "term").agg(F.sum("documents").alias("count")).where(F.col("count") >= min_df)
    frequent = cut(frequent.select("lang", "term", F.array("term").alias("terms")))
    # Hashed shards are uneven, so they are made for half the bound.
    n = frequent.select("term").distinct().count()
    shards = 1 if n <= vocabulary else -(-2 * n // vocabulary)
    words, counts = [], []
    for shard in range(shards if n else 0):
        own = frequent.where(_shard(F.col("term"), shards) == shard)
        if own.isEmpty():
            continue
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=1.0, vocabSize=2**31 - 1).fit(own.select("terms").distinct())
        words.append(cut(model.transform(own).select("lang", F.lit(shard).alias("shard"), F.unwrap_udt("v")["indices"][0].alias("index"), "term")))
        # A group's terms with the same number of occurrences are one bag, which stands for so many equal ones.
        bag = held.join(own.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source", "n").agg(F.collect_list("term").alias("terms"))
        vectors = model.transform(bag).select("lang", "source", "n", F.unwrap_udt("v").alias("v"))
        entries = vectors.select("lang", "source", "n", F.explode(F.arrays_zip("v.indices", "v.values")).alias("e"))
        n_all = (F.col("n") * F.col("e.values").cast("long")).alias("n")
        counts.append(cut(entries.select("lang", "source", F.lit(shard).alias("shard"), F.col("e.indices").alias("index"), n_all)))
    if not words:
        return groups, spark.createDataFrame([], "lang string, shard int, index int, term string"), spark.createDataFrame([], "lang string, source string, shard int, index int, n long")
    return groups, reduce(DataFrame.unionAll, words), reduce(DataFrame.unionAll, counts)


def smoothed(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 size)), exact; a group whose lang keeps no term divides by one."""
    below = F.greatest(total + 2 * size, F.lit(1)).cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)"), below) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square fits in a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _both_ways(df: DataFrame, a: str, b: str) -> DataFrame:
    one = df.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value")
    return one.unionAll(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def source_pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a lang's sources.

    ``groups`` has lang, source, v, p0 and ``entries`` lang, source, shard,
    index, p.  The pairs are the result itself; the work beyond them is one row for
    each two sources that share a term, summed before the shuffle.
    """
    stored = entries.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    lacking = groups.join(entries.groupBy("lang", "source").agg(F.count("*").alias("held")), ["lang", "source"], "left")
    lacking = lacking.select("lang", "source", F.col("p0").alias("p"), (F.col("v") - F.coalesce("held", F.lit(0))).alias("n"))
    # A lang's rows are spread over salts, and its groups are there at each.
    values = stored.unionAll(lacking).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALT)).cast("int"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    alone = values.join(others, ["lang", "salt"]).where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * divergence(F.col("p"), F.col("q0"))).alias("value"))

    mine = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALT)).cast("int"))
    lacked = mine.join(others, ["lang", "salt"]).where("source <> item").select("lang", "source", "item", (-F.col("v") * divergence(F.col("p0"), F.col("q0"))).alias("value"))

    known = entries.join(groups.select("lang", "source", "p0"), ["lang", "source"])
    left = known.select("lang", "shard", "index", "source", "p", "p0")
    right = known.select("lang", "shard", "index", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    more = divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)
    shared = left.join(right, ["lang", "shard", "index"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(more).alias("value"))

    parts = _both_ways(alone, "source", "item").unionAll(lacked).unionAll(_both_ways(shared, "source", "item"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the lang by divergence, all ranks, 0
    where the lang keeps no term.  Part ``term``: the ``top`` kept terms that
    the group uses more than its lang does.  Equal values stand in the order
    of the item's UTF-8 bytes.  Empty tables give no rows.
    """
    groups, kept, counts = group_counts(docs, min_df, vocabulary)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("v", none).alias("v"), F.coalesce("total", none).alias("total"))
    groups = cut(groups.withColumn("p0", smoothed(none, F.col("total"), F.col("v"))))
    entries = cut(counts.join(groups, ["lang", "source"]).select("lang", "source", "shard", "index", "n", smoothed(F.col("n"), F.col("total"), F.col("v")).alias("p")))
    pairs = source_pairs(groups, entries).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    whole = counts.groupBy("lang", "shard", "index").agg(F.sum("n").alias("n"))
    lang_total = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    whole = whole.join(lang_total, "lang").select("lang", "shard", "index", smoothed(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    words = kept.join(whole, ["lang", "shard", "index"])
    above = entries.join(words, ["lang", "shard", "index"]).where("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionAll(above.withColumn("rank", rank).where(F.col("rank") <= top))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
word AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT + 2 * v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM dense GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS i, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
             FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.s = a.source AND f.i = b.source),
above AS (
  SELECT d.lang, d.source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM dense d JOIN langs USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM above)
WHERE rank <= 10
"""


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
