"""Quality rules whose cutoffs carry a guarantee on false rejections.

A document is rejected when any of its measured ratios exceeds its stratum's
cutoff.  Cutoffs form one nested sequence, from loose to strict, and each rejects
all that the ones before it reject.  On the labelled good documents of a stratum
the exact binomial (Clopper-Pearson) test asks of one cutoff after the other
whether the share that it rejects is at most ``max_false_rejection``, and stops
at the first that isn't proven: within a sequence in a fixed order no further
correction is due.  The error level is divided by the number of strata
(Bonferroni), so with probability ``1 - error`` every stratum's verdict keeps the
promise.  With 2 % and 5 % a stratum needs 203 good documents for a verdict;
with fewer it rejects nothing.  The promise is about documents that pass the
fixed base rule; what that rejects is reported apart by ``base_rejections``.

Everything on the main path is DataFrame expressions.  Measures are computed
once, within the row, so no text is shuffled; strata are a fixed set of
expressions, so the table of cutoffs has at most ``len(STRATA)`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, let, unused, words

SYMBOLS = "#*$%&|<>"
#: Ratio columns; grid of cutoffs, strictest first.
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "shout_ratio")
GRID = tuple(round(0.02 * i, 2) for i in range(1, 36))
#: Documents are judged within their length class.
STRATA = ("short", "medium", "long")
MIN_WORDS = 50


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are compared by their 64-bit hash: sorted with their positions,
    equal neighbours are repeats, and the union of the repeats' positions is
    counted.  The cost is that of one sort of the text's windows.
    """

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeats(runs: Column) -> Column:
        n = F.size(runs)
        before = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("p"))), F.slice(runs, 1, n - 1))
        after = F.slice(runs, 2, n - 1)
        left = F.zip_with(runs, before, lambda a, b: F.when(a["h"] == b["h"], a["p"]))
        right = F.zip_with(runs, after, lambda a, b: F.when(a["h"] == b["h"], a["p"]))
        hits = F.array_sort(F.filter(F.zip_with(left, right, lambda a, b: F.coalesce(a, b)), lambda p: p.isNotNull()))
        return let(hits, covered)

    def windows(w: Column) -> Column:
        last = F.size(w) - 2
        hashes = F.transform(
            F.arrays_zip(F.slice(w, 1, last).alias("a"), F.slice(w, 2, last).alias("b"), F.slice(w, 3, last).alias("c")),
            lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("p")),
        )
        return let(F.sort_array(hashes), repeats)

    return F.when(F.size(tokens) < 3, F.lit(0).cast("long")).otherwise(let(tokens, windows))


def measured(docs: DataFrame) -> Column:
    """A struct of base measures of ``docs.text``; null texts measure as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))

    def of(w: Column) -> Column:
        joined = F.array_join(w, "")
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(joined).cast("long").alias("word_chars"),
            (F.char_length(joined) - F.char_length(F.translate(joined, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            repeated_words(w).alias("n_repeat_words"),
            (F.char_length(joined) - F.char_length(F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        )

    return let(words(text), of)


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def judged(m: Column) -> dict[str, Column]:
    """Stratum, rule ratios and base verdict from a struct of measures."""
    return {
        "stratum": F.when(m["n_words"] < 200, "short").when(m["n_words"] < 1000, "medium").otherwise("long"),
        "symbol_ratio": ratio(m["n_symbols"], m["word_chars"]),
        "dup_line_ratio": ratio(m["n_dup_lines"], m["n_lines"]),
        "repeat_ratio": ratio(m["n_repeat_words"], m["n_words"]),
        "shout_ratio": ratio(m["n_capitals"], m["word_chars"]),
        "base_failed": (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"]),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms.

    Terms follow from one another by their ratio, so no factorial overflows;
    the sum is carried as a logarithm.
    """
    start = n.cast("double") * math.log1p(-p)
    zero = F.struct(start.alias("term"), start.alias("total"))
    odds = math.log(p) - math.log1p(-p)

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1).cast("double")) - F.log(j.cast("double")) + F.lit(odds)
        high, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    more = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(more, zero, step, lambda s: s["total"]))


def good_labels(labels: DataFrame) -> DataFrame:
    """Ids labelled good.  Null ids and qualities are left out; of a repeated id the least quality counts."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label")).where("label = 1").select("doc_id")


def cutoffs(table: DataFrame, labels: DataFrame, max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, cutoff): the strictest cutoff of each stratum that its sequence proves.

    ``table`` has doc_id, stratum, base_failed and the ratios of every document;
    ids with good labels that pass the base rule teach (see ``good_labels``).
    """
    held = table.where(~F.col("base_failed")).join(good_labels(labels), "doc_id", "left_semi")
    worst = F.greatest(*RULES)
    per_stratum = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(worst > g).alias(f"k_{i}") for i, g in enumerate(GRID)])
    tests = F.array(*[F.struct(F.lit(g).alias("cutoff"), F.col(f"k_{i}").alias("k")) for i, g in enumerate(GRID)])
    each = per_stratum.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.cutoff", "t.k")
    # A share above the bound can't be proven below it, so the sum is short.
    tried = each.where(F.col("k") <= F.col("n") * max_false_rejection)
    proven = tried.where(binomial_cdf(F.col("k"), F.col("n"), max_false_rejection) <= error / len(STRATA))
    # A stricter cutoff never rejects fewer, so all looser ones are proven too.
    return proven.groupBy("stratum").agg(F.min("cutoff").alias("cutoff"))


def base_rejections(table: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, n_good, by_base, by_rules): good documents of each stratum, those that the base rule rejects, and of the others those that the fitted rules reject.

    ``table`` is the result of ``quality_rules``.
    """
    held = table.join(good_labels(labels), "doc_id", "left_semi")
    by_rules = ~F.col("base_failed") & ~F.col("kept")
    return held.groupBy("stratum").agg(F.count("*").alias("n_good"), F.count_if("base_failed").alias("by_base"), F.count_if(by_rules).alias("by_rules"))


def rejected(stratum: Column, ratios: dict[str, Column], chosen: list) -> Column:
    """True where a ratio exceeds its stratum's cutoff (a list of one row a stratum at most)."""
    out = F.lit(False)
    for r in chosen:
        out = out | ((stratum == r["stratum"]) & (F.greatest(*[ratios[k] for k in RULES]) > F.lit(r["cutoff"])))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """Measures and verdict of every document.

    Null and empty texts have zero words and fail the base rule.  Repeated rows
    stay repeated; a null doc_id is judged but never used as a label.  Columns
    of ``docs`` besides doc_id and text are not read.
    """
    m = F.col("m")
    measures = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured(docs).alias("m"))
    table = cut(measures.select("doc_id", "m.*", *[c.alias(k) for k, c in judged(m).items()]))
    chosen = cutoffs(table, labels, max_false_rejection, error).collect()
    verdict = ~F.col("base_failed") & ~rejected(F.col("stratum"), {r: F.col(r) for r in RULES}, chosen)
    return table.withColumn("kept", verdict)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with exactly the columns of ``docs``.

    The documents are written once beside their measures; cutoffs are fitted on
    the narrow columns of that table and the verdict filters its rows, so no
    text is shuffled and no measure computed twice.  Null and empty texts fail
    the base rule.  A null doc_id is judged but teaches nothing; repeated rows
    are judged alike and stay repeated; with an empty labels table only the base
    rule rejects.
    """
    (own,) = unused(docs, "measures")
    table = cut(docs.withColumn(own, measured(docs)))
    m = table.select("doc_id", F.col(own).alias("m"))
    chosen = cutoffs(m.select("doc_id", *[c.alias(k) for k, c in judged(F.col("m")).items()]), labels, **options).collect()
    parts = judged(F.col(own))
    return table.where(~parts["base_failed"] & ~rejected(parts["stratum"], parts, chosen)).select(*docs.columns)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_RATIOS = {
    "symbol_ratio": "n_symbols::DOUBLE / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
    "shout_ratio": "n_capitals::DOUBLE / greatest(word_chars, 1)",
}

ORACLE = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM base b LEFT JOIN cov c USING (doc_id)),
t AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words < 200 THEN 'short' WHEN n_words < 1000 THEN 'medium' ELSE 'long' END AS stratum
  FROM m),
r AS (
  SELECT doc_id, stratum, base_failed, greatest({", ".join(_RATIOS.values())}) AS x FROM t),
good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
tried AS (
  SELECT stratum, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k
  FROM r SEMI JOIN good USING (doc_id), (SELECT unnest([{", ".join(f"{g}::DOUBLE" for g in GRID)}]) AS cutoff)
  WHERE NOT base_failed GROUP BY ALL HAVING k <= n * 0.02::DOUBLE),
tails AS (
  SELECT stratum, cutoff, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02::DOUBLE) + (n - j) * ln(0.98::DOUBLE))) AS cdf
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM tried) GROUP BY ALL),
chosen AS (
  SELECT stratum, min(cutoff) AS cutoff FROM tails WHERE cdf <= {0.05 / len(STRATA)!r} GROUP BY ALL),
bad AS (
  SELECT DISTINCT doc_id FROM r JOIN chosen USING (stratum) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.doc_id IS NULL AS kept
FROM t LEFT JOIN bad USING (doc_id)
"""
