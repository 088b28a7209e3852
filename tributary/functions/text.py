"""Text expressions: normalisation, tokens, set and multiset similarity, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary import config

PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalize(text: Column) -> Column:
    """Lower case, ASCII punctuation to spaces, white space collapsed; null gives ''."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(low, "[ \t-\r]+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def collapse_whitespace(text: Column) -> Column:
    """White space collapsed and trimmed, case and punctuation kept."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t-\r]+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^ \t-\r]+"), F.lit(0)))


def collapse_repeats(t: Column) -> Column:
    """The smallest block of two or more tokens whose repetition is the whole list, else the list."""
    n = F.size(t)
    sizes = F.filter(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(n / 2).cast("int"))),
        lambda b: (n % b == 0) & (F.flatten(F.array_repeat(F.slice(t, F.lit(1), b), F.floor(n / b).cast("int"))) == t),
    )
    block = F.transform(sizes, lambda b: F.slice(t, F.lit(1), b))
    return F.when(n >= 4, F.coalesce(F.try_element_at(block, F.lit(1)), t)).otherwise(t)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Bound to a lambda variable, the expression can't be repeated inside loops.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(t: Column) -> Column:
    """Tokens marked with their occurrence, so that multisets compare as sets."""
    return let(F.array_sort(t), lambda s: F.transform(s, lambda w, i: F.concat_ws("#", w, (i + 1 - F.array_position(s, w)).cast("string"))))


def bag(t: Column) -> Column:
    """The multiset of a token list after its repetition collapses, in the form ``bag_jaccard`` compares."""
    return let(let(t, collapse_repeats), numbered)


def bag_jaccard(a: Column, b: Column) -> Column:
    """Shared over joint token counts of two bags; null if both are silent, 0 if one is."""
    silent_a, silent_b = F.size(a) == 0, F.size(b) == 0
    ratio = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when(silent_a & silent_b, F.lit(None).cast("double")).when(silent_a | silent_b, F.lit(0.0)).otherwise(ratio)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """``bag_jaccard`` of two token lists."""
    return let(F.struct(bag(a).alias("a"), bag(b).alias("b")), lambda x: bag_jaccard(x["a"], x["b"]))


def set_jaccard(a: Column, b: Column) -> Column:
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / joint)


def gate_tokens(text: Column) -> Column:
    """Word tokens with possessives and plurals stripped and number words as digits."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))

    def ends(t, s):
        return F.endswith(t, F.lit(s))

    def cut(t, n):
        return F.left(t, F.char_length(t) - n)

    def owner(t):
        return F.when(ends(t, "'s"), cut(t, 2)).when(ends(t, "'"), cut(t, 1)).otherwise(t)

    def stem(t):
        n = F.char_length(t)
        return (
            F.when(ends(t, "ies") & (n > 4), F.concat(cut(t, 3), F.lit("y")))
            .when(ends(t, "es") & (n > 4) & ~ends(t, "ses"), cut(t, 2))
            .when(ends(t, "s") & (n > 3) & ~ends(t, "ss") & ~ends(t, "us") & ~ends(t, "is"), cut(t, 1))
            .otherwise(t)
        )

    words = F.array(*map(F.lit, config.NUMBER_WORDS))

    def digit(t):
        at = F.array_position(words, t)
        return F.when(at > 0, (at - 1).cast("string")).otherwise(t)

    return F.transform(F.transform(F.transform(raw, owner), stem), digit)


def clock_millis(seconds: Column) -> Column:
    """mm:ss.mmm of a time in seconds; negative times count as zero."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d.%03d", F.expr("0") + F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def unfenced_json(raw: Column) -> Column:
    """Text between triple-backtick fences if there are any, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def parse_clock_lines(text: Column) -> Column:
    """Lines ``[mm:ss-mm:ss] 'text'`` (en dash) as (start, end, text); other lines are skipped."""
    pattern = "^\\[(\\d+):(\\d+)–(\\d+):(\\d+)\\] '(.*)'$"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))

    def part(x, i):
        return F.regexp_extract(x, pattern, i)

    def seconds(x, i):
        return (part(x, i).cast("long") * 60 + part(x, i + 1).cast("long")).cast("double")

    return F.transform(lines, lambda x: F.struct(seconds(x, 1).alias("start"), seconds(x, 3).alias("end"), part(x, 5).alias("text")))


def marked_edit(text: Column, prose: Column) -> Column:
    """How prose marks a quoted line: deleted, trimmed, replaced or null."""

    def marked(*marks):
        return F.exists(F.array(*map(F.lit, marks)), lambda m: F.rlike(prose, F.concat(F.lit("(?s)'\\Q"), text, F.lit("\\E'.{0,200}?"), m)))

    return F.when(marked("--> DELETED", "--> deleted", "deleted entirely"), "delete").when(marked("--> TRIMMED"), "trim").when(marked("--> REPLACED"), "replace")
