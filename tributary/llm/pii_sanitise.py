"""Personal data: exact spans by pattern, and terms that would give it away.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.
Their values are the protected entities.  For each word that shares a document
with an entity, the corpus tells how strongly it reveals it: with P(e|t) the
share of the term's documents that hold the entity, the term discloses
``log2(P(e|t) / P(e))`` of the entity's ``-log2 P(e)`` bits.  A term that
discloses at least ``disclosure`` of the bits, in at least ``support``
different texts, is an added span wherever it occurs, in documents without the
entity too: removed when it discloses ``removal`` of them, generalised otherwise.

Everything is DataFrame expressions.  Spans are found and replaced within the
row, in a cost that grows with the text and its matches.  Texts with entities
collapse to their distinct values and words before these meet, and word counts
are aggregated before their shuffle, so frequent words and groups of copies meet
as partial counts.  The rows that hold a disclosing term join the texts by id
and hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, let, unused

#: Kinds in reporting order.  Possessive loops and anchors keep the patterns
#: linear; they match what the plain patterns of the contract match.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{L}{3,}+"
#: A letter that stands for the characters of an entity; words that touch it are part of the entity.
FILLER = "\u3164"
_BLOCK = 256
_PIECE = 1024


def _numbers(x: Column, size: int) -> Column:
    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), ((F.size(x) - 1) / size).cast("int")))


def running(x: Column, least: int, total, join) -> Column:
    """Running totals of an array of integers under an operation with neutral value ``least``.

    ``total`` is the operation over an array and ``join`` that over two values.
    Blocks are totalled apart and then begun with what stands before them, so a
    long array costs little more than its length.
    """
    none = F.array().cast("array<int>")

    def first_values(blocks: Column) -> Column:
        start = F.struct(F.lit(least).alias("at"), none.alias("out"))
        return F.aggregate(blocks, start, lambda s, b: F.struct(join(s["at"], total(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def inside(block: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), none.alias("out"))
        return F.aggregate(block, start, lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(join(s["at"], v))).alias("out")), lambda s: s["out"])

    def of(own: Column) -> Column:
        blocks = F.transform(_numbers(own, _BLOCK), lambda i: F.slice(own, i * _BLOCK + 1, _BLOCK))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, first_values(b), inside)))

    return let(x, of)


def running_sums(x: Column) -> Column:
    return running(x, 0, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v), lambda a, b: a + b)


def running_most(x: Column) -> Column:
    return running(x, -1, lambda b: F.coalesce(F.array_max(b), F.lit(-1)), lambda a, b: F.greatest(a, b))


def merged(spans: Column) -> Column:
    """Sorted spans (start, end, ...) as (start, end, first) without overlaps: each group of overlapping spans under its first."""

    def closed(x: Column) -> Column:
        most, heads = x["most"], x["heads"]
        last = F.get(most, F.size(most) - 1)
        return F.transform(heads, lambda k, i: F.struct(k["first"]["start"].alias("start"), F.coalesce(F.get(heads, i + 1)["before"], last).alias("end"), k["first"].alias("first")))

    def of(own: Column) -> Column:
        def heads(most: Column) -> Column:
            before = F.transform(own, lambda s, i: F.struct(s.alias("first"), F.coalesce(F.get(most, i - 1), F.lit(-1)).alias("before")))
            return F.struct(most.alias("most"), F.filter(before, lambda x: x["first"]["start"] >= x["before"]).alias("heads"))

        return let(let(running_most(F.transform(own, lambda s: s["end"])), heads), closed)

    return let(spans, of)


def spliced(text: Column, spans: Column, put) -> Column:
    """``text`` with each of the merged spans replaced by ``put(span)``.

    The text is cut at every 1,024th span before single spans are, so a long
    text with many spans is not read from its start for each.
    """

    def whole(own: Column) -> Column:
        def block(i: Column) -> Column:
            inside = F.slice(own, i * _PIECE + 1, _PIECE)
            begin, end = F.coalesce(F.get(own, i * _PIECE - 1)["end"], F.lit(0)), F.get(own, F.least((i + 1) * _PIECE, F.size(own)) - 1)["end"]
            return F.struct(begin.alias("begin"), inside.alias("spans"), F.substring(text, begin + 1, end - begin).alias("piece"))

        def filled(x: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                at = F.coalesce(F.get(x["spans"], i - 1)["end"], x["begin"])
                return F.concat(F.substring(x["piece"], at - x["begin"] + 1, s["start"] - at), put(s))

            return F.array_join(F.transform(x["spans"], one), "")

        rest = F.substring(text, F.coalesce(F.get(own, F.size(own) - 1)["end"], F.lit(0)) + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform(F.transform(_numbers(own, _PIECE), block), filled), ""), rest)

    return let(spans, whole)


def located(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value).

    Positions are code points.  Gaps and matches alternate, so positions are
    running sums of their lengths.
    """

    def of(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.char_length(g) + F.char_length(v))

        def placed(ends: Column) -> Column:
            return F.zip_with(ends, found, lambda e, v: F.struct((e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))

        return let(running_sums(lengths), placed)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found")), of)


def passes_luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return s + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = "0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
        return x.rlike(rf"^{small}(?:\.{small}){{3}}$")
    digits = _digits(x)
    length = F.char_length(digits)
    if kind == "phone":
        return length.between(9, 15)
    return F.when(length.between(13, 19), passes_luhn(digits)).otherwise(F.lit(False))


_HIT = "array<struct<kind:int,start:int,end:int,value:string>>"


def base_hits(text: Column) -> Column:
    """All valid base spans as an array of (kind number, start, end, value), in reporting order."""
    worth = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    number = text.rlike("[0-9]")

    def of(kind: str) -> Column:
        value = (lambda x: F.lower(x["value"])) if kind == "email" else (lambda x: _digits(x["value"]) if kind != "ip" else x["value"])
        kept = F.filter(located(text, F.lit(PATTERNS[kind])), lambda x: _valid(kind, x["value"]))
        hits = F.transform(
            kept,
            lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value(x).alias("value")),
        )
        return F.when(worth.get(kind, number), hits).otherwise(F.array().cast(_HIT))

    return F.concat(*[of(k) for k in KINDS[:4]])


def masked(text: Column, hits: Column) -> Column:
    """The text with every character of an entity replaced by the filler."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    plain = F.translate(text, FILLER, " ")
    hidden = spliced(plain, merged(spans), lambda s: F.repeat(F.lit(FILLER), s["end"] - s["start"]))
    return F.when(F.size(hits) == 0, plain).otherwise(hidden)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _with_hits(docs: DataFrame, hits: str) -> DataFrame:
    """``docs`` with the base spans of each row; a variable keeps the optimizer from evaluating the search again for each use."""
    return docs.withColumn(hits, let(_text(docs), base_hits))


def found(docs: DataFrame) -> DataFrame:
    """(id, text_hash, hits, words) for every row, written once; ``words`` are the distinct words that don't touch an entity."""
    rows = _with_hits(docs.select("doc_id", "text"), "hits")
    rows = rows.withColumn("hidden", masked(_text(rows), F.col("hits")))
    words = F.array_distinct(F.filter(F.regexp_extract_all("hidden", F.lit(WORD), F.lit(0)), lambda w: ~F.contains(w, F.lit(FILLER))))
    return cut(rows.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(_text(rows)).alias("text_hash"), "hits", words.alias("words")))


def disclosing_terms(table: DataFrame, disclosure: float = 0.95, removal: float = 0.99, support: int = 2) -> DataFrame:
    """(value, term, revealed, remove): terms that give an entity away.

    ``table`` has text_hash, hits and words of ``found(docs)``.  Terms and
    entities are counted once for each row that holds them, over all rows.
    """
    terms = F.array_distinct(F.transform("words", F.lower))
    values = F.array_distinct(F.transform("hits", lambda h: h["value"]))
    some = table.where(F.size("hits") > 0).select("text_hash", values.alias("values"), terms.alias("terms"))
    texts = cut(some.groupBy("text_hash").agg(F.count("*").alias("copies"), F.first("values").alias("values"), F.first("terms").alias("terms")))
    entities = texts.select(F.explode("values").alias("value"), "copies").groupBy("value").agg(F.sum("copies").alias("holding"), F.count("*").alias("contexts"))
    entities = cut(entities.where(F.col("contexts") >= support).select("value", "holding"))
    beside = texts.select(F.explode("values").alias("value"), "copies", "terms").join(entities, "value").select("value", "copies", F.explode("terms").alias("term"))
    pairs = cut(beside.groupBy("value", "term").agg(F.sum("copies").alias("together"), F.count("*").alias("contexts")).where(F.col("contexts") >= support))
    counts = table.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("occurrences"))
    counts = cut(counts.join(pairs.select("term").distinct(), "term", "left_semi"))
    total = table.count() or 1
    rated = pairs.join(counts, "term").join(entities, "value")
    prior = F.col("holding") / F.lit(float(total))
    revealed = F.log2(F.col("together") / F.col("occurrences") / prior) / -F.log2(prior)
    out = rated.select("value", "term", F.when(prior < 1, revealed).otherwise(F.lit(0.0)).alias("revealed"))
    return out.where(F.col("revealed") >= disclosure).withColumn("remove", F.col("revealed") >= removal)


def _held(docs: DataFrame, **options) -> DataFrame:
    """(id, text_hash, held) of the rows that hold disclosing words, and those words."""
    table = found(docs)
    terms = cut(disclosing_terms(table, **options).groupBy("term").agg(F.max("remove").alias("remove")))
    words = table.select("id", "text_hash", F.explode("words").alias("word")).withColumn("term", F.lower("word"))
    held = cut(words.join(terms, "term").groupBy("id", "text_hash").agg(F.collect_set(F.struct("word", "remove")).alias("held")))
    discard(table, terms)
    return held


def marked(docs: DataFrame, hits: str, added: str, **options) -> DataFrame:
    """``docs`` with each row's base spans and all occurrences of disclosing words outside them, as arrays ``hits`` and ``added``.

    Only rows that hold such a word are on the other side of the join, without
    their texts; Spark broadcasts that side where its size in bytes allows.
    """
    held, own_id, own_hash, hidden = unused(docs, "held", "held_id", "held_hash", "hidden")
    words = _held(docs, **options).toDF(own_id, own_hash, held)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(_text(docs)) == F.col(own_hash))
    rows = _with_hits(docs.join(words, same, "left").drop(own_id, own_hash), hits)
    rows = rows.withColumn(hidden, F.when(F.col(held).isNotNull(), masked(_text(rows), F.col(hits))))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(held, lambda t: t["word"]), "|"), F.lit(r")(?!\p{L})"))

    def spots(removed: Column) -> Column:
        return F.transform(located(F.col(hidden), pattern), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(removed, x["value"]).alias("remove")))

    none = F.array().cast("array<struct<start:int,end:int,remove:boolean>>")
    found_words = F.when(F.col(held).isNotNull(), let(F.map_from_entries(held), spots)).otherwise(none)
    return rows.withColumn(added, found_words).drop(hidden, held)


def sanitised_spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_hash, hits, added) for every row of ``docs``.

    ``hits`` are base spans and ``added`` all occurrences of disclosing terms
    outside them as (start, end, remove).  Null and empty texts have none.  Rows
    with equal id and text get equal spans and stay repeated; a null doc_id is
    matched as a value.  Columns besides doc_id and text are not read.
    """
    rows = marked(docs.select("doc_id", "text"), "hits", "added", **options)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text(rows)).alias("text_hash"), "hits", "added")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and the list of all spans."""
    plain = F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end")))
    terms = F.transform("added", lambda a: F.struct(F.lit(4).alias("kind"), a["start"].alias("start"), a["end"].alias("end")))

    def count(k: int) -> Column:
        return F.size(F.filter("hits", lambda h: h["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    listed = spans.select("doc_id", *counts, F.array_sort(plain).alias("plain"), F.array_sort(F.array_distinct(terms)).alias("terms"))
    base = _listed(F.col("plain"))
    return listed.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.concat("plain", "terms")).alias("spans")
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced in its text, same rows and columns.

    Base spans become their kind in brackets; added terms are removed or become
    ``[TERM]``.  Overlapping spans are replaced once, under the first's kind.  A
    null text stays null and null ids are matched as a value; repeated rows
    stay repeated and are changed alike; a column n_chars, if any, follows the
    new text.
    """
    hits, added, changes = unused(docs, "hits", "added", "changes")
    table = marked(docs, hits, added, **options)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.element_at(labels, h["kind"] + 1).alias("put")))
    more = F.transform(added, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), F.when(a["remove"], "").otherwise("[TERM]").alias("put")))
    rows = table.withColumn(changes, merged(F.array_sort(F.concat(base, more))))
    untouched = F.col("text").isNull() | (F.size(changes) == 0)
    rebuilt = spliced(F.col("text").cast("string"), F.col(changes), lambda s: s["first"]["put"])
    text = F.when(untouched, F.col("text")).otherwise(rebuilt)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("text", text).withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    else:
        rows = rows.withColumn("text", text)
    return rows.select(*docs.columns)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(sanitised_spans(docs))
