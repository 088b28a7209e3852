"""Patterns whose literals touch other letters or digits of a URL."""

import re

from tributary.llm import url_filter
from tributary.llm.url_filter import PATTERNS, Pattern, bordered_literals


def test_index_tokens_have_fixed_borders():
    assert {p.expression: set(p.tokens) for p in PATTERNS} == {
        r"[/.]cheap-pills\.": {"cheap", "pills"}, r"[/.]free-bets\.": {"free", "bets"}, r"[/.]spam-[a-z]+\.": {"spam"}, r"[/.]ads-track[a-z]*\.": {"ads"},
        r"[/.-]casino[0-9]*[/.-]": set(), r"[/.]adult-[a-z]+\.": {"adult"}, r"[/.-](win|buy)-[a-z]+-online\.": {"online"}, r"[/.-]payday-loans?[/.]": {"payday"},
        r"\.exe(\?|#|$)": set(),
    }
    for free in ("casino", "-casino", "[^x]casino-", "-a|-casino-", "-(casino)-", "-casino.", "(?i)-casino-", "-*casino-", r"\Wcasino-", "-cas[i]?ino-"):
        assert "casino" not in bordered_literals(free), free


def test_casino_with_digits_is_blocked(spark):
    urls = ["http://casino88.example.org/", "http://a.org/casino7/x", "http://a.org/casinos/x", "http://a.org/bigcasino.x", "http://a.org/setup.exe", "http://a.org/x.exe?y", "http://www.spam-x1.y.org/", "http://b.org/ads-tracker.js"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for patterns in (PATTERNS, (Pattern("casino", ("casino",)), Pattern("xe", ()))):
        got = {r.page_id: (r.verdict, r.pattern) for r in url_filter.filter_urls(pages, patterns=patterns).collect()}
        for i, url in enumerate(urls):
            first = next((p.expression for p in patterns if re.search(p.expression, url.lower())), None)
            assert got[i] == ("block" if first else "allow", first), url
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == got[1] == "block"
