"""Disclosing terms count, and are marked, wherever they stand."""

import re

from tributary.llm import pii_sanitise


def named(rows, spans):
    return {i: [t[int(a) : int(b)] for a, b in re.findall(r"term:(\d+):(\d+)", spans[i])] for i, t in rows}


def test_terms_far_from_the_entity_and_without_it(spark):
    usual = "the usual words went over the hill and came home again "
    rows = [(i, f"Zorblax {usual * (4 + i)} ann@x.org {usual * 4} zorblax") for i in range(6)]
    rows += [(7, f"nothing but ZORBLAX zorblaxes xzorblax {usual}"), (8, "zorblax@y.org zorblaxü"), (9, "")]
    rows += [(10 + i, f"{usual * 3} number{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_sanitise.digests(pii_sanitise.sanitised_spans(docs)).collect()}
    terms = named(rows, got)
    assert all(terms[i] == ["Zorblax", "zorblax"] for i in range(6))
    assert terms[7] == ["ZORBLAX"] and terms[8] == []
    assert not any(terms[10 + i] for i in range(400))
    text = {r.doc_id: r.text for r in pii_sanitise.redact(docs).collect()}
    assert not any(re.search(r"\bzorblax\b", text[i], re.IGNORECASE) for i in [*range(6), 7])
    assert text[8] == "[EMAIL] zorblaxü" and text[10] == rows[9][1]
