"""URL filters: host and path rules, and patterns indexed by their rarest literal token.

A pattern is tried only on URLs that contain its index token.  The token is the
rarest, over all URLs of the table, of the literals the pattern can't match
without; those counts come from one aggregation over the table, restricted to
the literals of the rules.  A literal is an index token only where the
expression itself fixes both its borders, so that it is a whole token of every
URL that matches; a pattern without such a literal is tried on every URL.
Rules number at most ``MAX_RULES``, which bounds the index that every task holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, lru_cache
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
TOKEN = "[a-z0-9]+"


_TOKEN_CODES = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyz0123456789"))


def _only_borders(op, value) -> bool:
    """Whether a parsed item consumes one character, and never one of a token."""
    if op is C.LITERAL:
        return value not in _TOKEN_CODES
    if op is not C.IN or value[0][0] is C.NEGATE:
        return False
    for kind, x in value:
        if kind is C.LITERAL and x not in _TOKEN_CODES:
            continue
        if kind is C.RANGE and _TOKEN_CODES.isdisjoint(range(x[0], x[1] + 1)):
            continue
        return False
    return True


def bordered_literals(expression: str) -> set[str]:
    """Tokens that stand whole in every text the expression matches.

    Runs of plain characters at the top level count if the items on both sides
    consume a character that no token holds.  Everything else, flags included,
    gives none.
    """
    parsed = _parser.parse(expression)
    if parsed.state.flags & ~C.SRE_FLAG_UNICODE:
        return set()
    out, run, whole = set(), "", False
    for op, value in parsed:
        if op is C.LITERAL and value in _TOKEN_CODES:
            run += chr(value)
            continue
        border = _only_borders(op, value)
        if run and whole and border:
            out.add(run)
        run, whole = "", border
    return out


@dataclass(frozen=True)
class Pattern:
    """A block pattern; ``tokens`` are the literals that may index it, derived from the expression.

    ``literals``, if any are named, are the only ones considered.
    """

    expression: str
    literals: tuple[str, ...] = ()

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        whole = sorted(bordered_literals(self.expression))
        return tuple(t for t in whole if not self.literals or t in self.literals)


#: Host and path rules: (verdict, host, path prefix).
PLACE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Block patterns on the lower-cased URL, first match wins.
PATTERNS = tuple(
    Pattern(x)
    for x in (
        r"[/.]cheap-pills\.",
        r"[/.]free-bets\.",
        r"[/.]spam-[a-z]+\.",
        r"[/.]ads-track[a-z]*\.",
        r"[/.-]casino[0-9]*[/.-]",
        r"[/.]adult-[a-z]+\.",
        r"[/.-](win|buy)-[a-z]+-online\.",
        r"[/.-]payday-loans?[/.]",
        r"\.exe(\?|#|$)",
    )
)


def patterns_of(rules: DataFrame) -> tuple[Pattern, ...]:
    """Patterns of a table with a column ``expression``, in the order of ``rank`` where it has one; nulls and repeats are left out.

    A table of more than ``MAX_RULES`` expressions is refused, so what the
    driver and every task hold is bounded.
    """
    rank = F.min("rank") if "rank" in rules.columns else F.lit(0)
    rows = rules.where("expression is not null").groupBy("expression").agg(rank.alias("rank")).orderBy("rank", "expression").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return tuple(Pattern(r.expression) for r in rows)


_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = {c: c + 32 for c in range(65, 91)}


def place(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or no ``://``."""
    found = _HOST.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def rarest_tokens(pages: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> dict[str, str]:
    """Pattern expression -> its rarest index token over all URLs of ``pages``; patterns without one are left out."""
    literals = sorted({t for p in patterns for t in p.tokens})
    if not literals:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit(f"({TOKEN})")))
    # At most as many literals as rules have, so the other side is small.
    wanted = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in literals], "t string"))
    counts = {r.t: r.n for r in pages.select(F.explode(tokens).alias("t")).join(wanted, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n")).collect()}
    return {p.expression: min(p.tokens, key=lambda t: (counts.get(t, 0), t)) for p in patterns if p.tokens}


def filter_urls(pages: DataFrame, places=PLACE_RULES, patterns=PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for every row of ``pages``.

    The longest host and path rule that fits decides; where none fits, the
    patterns do: block at the first match, else allow.  Expressions are searched
    in the lower-cased URL.
    Null and malformed URLs have an empty host and path, fit no rule and are
    allowed.  Repeated rows stay repeated; other columns are not read.
    """
    if len(places) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in places:
        by_host.setdefault(host, []).append((path, host + path, verdict))
    index_tokens = rarest_tokens(pages, patterns)
    by_token: dict[str, list[tuple[int, str]]] = {}
    everywhere: list[tuple[int, str]] = []
    for rank, p in enumerate(patterns):
        at = by_token.setdefault(index_tokens[p.expression], []) if p.expression in index_tokens else everywhere
        at.append((rank, p.expression))
    index = pages.sparkSession.sparkContext.broadcast((by_token, everywhere))

    def run(batches):
        by_token, everywhere = index.value
        compiled = lru_cache(maxsize=None)(re.compile)  # only what candidates need
        token = re.compile(TOKEN)

        def judge(url):
            host, path = place(url)
            labels = host.split(".") if host else []
            best = None
            for i in range(len(labels)):
                for prefix, rule, verdict in by_host.get(".".join(labels[i:]), ()):
                    if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                        best = rule, verdict
            if best:
                return host, path, *best, None
            low = (url or "").lower()
            candidates = sorted({*everywhere, *(c for t in set(token.findall(low)) & by_token.keys() for c in by_token[t])})
            for _, expression in candidates:
                if compiled(expression).search(low):
                    return host, path, None, "block", expression
            return host, path, None, "allow", None

        for batch in batches:
            columns = list(zip(*map(judge, batch.column(1).to_pylist()))) or [()] * 5
            arrays = [pa.array(c, pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    schema = "page_id long, host string, path string, rule string, verdict string, pattern string"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, schema)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_BLOCKED = " OR ".join(f"regexp_matches(lower(url), '{p.expression}')" for p in PATTERNS)
_FITS = " UNION ALL ".join(
    f"SELECT '{v}' AS verdict, '{h}' AS rhost, '{p}' AS rpath" for v, h, p in PLACE_RULES
)
ORACLE = f"""
WITH rules AS ({_FITS}),
u AS (SELECT row_number() OVER () AS rid, page_id, url,
        CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
      FROM pages),
fit AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule,
         arg_max(verdict, length(rhost) + length(rpath)) AS verdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (rid)
"""
