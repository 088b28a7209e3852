"""Types of validated records: what has the right keys but the wrong types is refused."""

import json

import pytest
from pyspark.sql import functions as F

from tributary.operators import validate

CLAIM = {"claim_id": "C1", "meaning": "m", "claim_type": "qualifier", "importance": "high", "evidence_regions": [{"start": 0, "end": 1.5, "description": "d"}], "equivalents": []}
SPAN = CLAIM["evidence_regions"][0]
VERDICT = {"claim_id": "", "branch": "combined", "status": "broken", "rationale": "r", "surviving_evidence": [SPAN]}


def judge(spark, check, records):
    rows = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i int, raw string")
    return [r.p for r in rows.select("i", check(F.col("raw")).alias("p")).orderBy("i").collect()]


def test_claim_types(spark):
    cases = [
        (CLAIM, None), ({**CLAIM, "meaning": 5}, "blank meaning"), ({**CLAIM, "meaning": {"a": 1}}, "blank meaning"), ({**CLAIM, "meaning": None}, "blank meaning"), ({**CLAIM, "meaning": ["m"]}, "blank meaning"),
        ({**CLAIM, "claim_id": 1}, "blank claim id"), ({**CLAIM, "claim_id": True}, "blank claim id"), ({**CLAIM, "claim_type": ["qualifier"]}, "claim type"), ({**CLAIM, "importance": None}, "importance"),
        ({**CLAIM, "evidence_regions": None}, "evidence"), ({**CLAIM, "evidence_regions": {}}, "evidence"), ({**CLAIM, "evidence_regions": "[]"}, "evidence"), ({**CLAIM, "equivalents": None}, "equivalents"),
        ({**CLAIM, "evidence_regions": [{**SPAN, "description": 7}]}, "evidence"), ({**CLAIM, "evidence_regions": [{**SPAN, "description": None}]}, "evidence"), ({**CLAIM, "evidence_regions": [{**SPAN, "start": [0]}]}, "evidence"),
        ({**CLAIM, "evidence_regions": [{**SPAN, "start": None}]}, "evidence"), ({**CLAIM, "evidence_regions": [SPAN, [SPAN]]}, "evidence"), ({**CLAIM, "evidence_regions": [{**SPAN, "end": "later"}]}, "evidence"),
        # A number in quotes is a number, as the checked models read it.
        ({**CLAIM, "evidence_regions": [{**SPAN, "end": "2.5"}]}, None),
        ("null", "malformed"), ("7", "malformed"), ('"text"', "malformed"), ("", "malformed"), ("{} {}", "malformed"), ('{"claim_id":"a","claim_id":"b"}', "malformed"), ({}, "missing key"),
    ]
    assert judge(spark, validate.claim_problem, [c for c, _ in cases]) == [p for _, p in cases]
    null = spark.createDataFrame([(None,)], "raw string")
    assert null.select(validate.claim_problem(F.col("raw")).alias("p")).first().p == "malformed"


def test_verdict_types(spark):
    cases = [
        (VERDICT, None), ({**VERDICT, "claim_id": 3}, "claim id"), ({**VERDICT, "rationale": 1.5}, "blank rationale"), ({**VERDICT, "status": {"s": "broken"}}, "status"), ({**VERDICT, "branch": None}, "branch"),
        ({**VERDICT, "surviving_evidence": None}, "evidence"), ({k: v for k, v in VERDICT.items() if k != "surviving_evidence"}, None),
    ]
    assert judge(spark, validate.survival_problem, [c for c, _ in cases]) == [p for _, p in cases]


@pytest.fixture(scope="module")
def analysis(spark):
    raw = spark.range(1).select(validate.expected_payload(*map(F.lit, ("preserved", "broken", "broken", "creates_new_conflict"))).alias("p")).first().p
    return json.loads(raw)


def test_analysis_types(spark, analysis):
    def impact(**changes):
        return {**analysis, "branch_b_impact": {**analysis["branch_b_impact"], **changes}}

    def pair(**changes):
        return {**analysis, "interactions": [analysis["interactions"][0], {**analysis["interactions"][0], **changes}]}

    flags = {"branch_a_safe": True, "branch_b_safe": False, "combined_safe": False}
    cases = [
        (analysis, None), ({**analysis, "interactions": None}, "no interaction"), ({**analysis, "interactions": {}}, "no interaction"), ({**analysis, "interactions": [None]}, "interaction"), ({**analysis, "notes": None}, None),
        ({**analysis, "notes": 4}, "notes"), ({**analysis, "legacy_v1_compat": flags}, None), ({**analysis, "legacy_v1_compat": {**flags, "x": True}}, "legacy v1 compat"), ({**analysis, "legacy_v1_compat": {**flags, "combined_safe": []}}, "legacy v1 compat"),
        ({**analysis, "branch_b_impact": None}, "branch_b: malformed"), ({**analysis, "branch_b_impact": [1]}, "branch_b: malformed"), ({**analysis, "overall_confidence": [1]}, "overall confidence"), ({**analysis, "overall_confidence": "0.5"}, None),
        (impact(affected_claims=[1]), "branch_b: affected claims"), (impact(affected_claims=None), "branch_b: affected claims"), (impact(preserved_equivalents="x"), "branch_b: preserved equivalents"), (impact(rationale=0), "branch_b: blank rationale"),
        (impact(evidence=[{"video": "base", "start": 0, "end": 1}]), "branch_b: evidence"), (impact(evidence=[{"video": 1, "start": 0, "end": 1, "description": "d"}]), "branch_b: evidence"),
        (pair(conflict_type=None), None), (pair(conflict_type=7), "interaction"), (pair(base_claim=7), "interaction"), (pair(branch_a_edit_ids=[1]), "interaction"), (pair(branch_a_edit_ids=None), "interaction"), (pair(confidence={}), "interaction"),
    ]
    assert judge(spark, validate.analysis_problem, [c for c, _ in cases]) == [p for _, p in cases]
