from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from contactmill.operators import scoring as K
from contactmill.sources.files import load_rules

LEADS = "id string, business_name string, business_type string, website string, google_rating double, google_review_count int, score int, pipeline_stage string"
EMAILS = "lead_id string, verification_status string"
ENRICHMENT = "lead_id string, has_multiple_tutors boolean, existing_scheduling_tool string, linkedin_url string, facebook_url string"


def tables(spark, leads, emails=(), enrichment=()):
    return (
        spark.createDataFrame(leads, LEADS),
        spark.createDataFrame(list(emails), EMAILS),
        spark.createDataFrame(list(enrichment), ENRICHMENT),
    )


@pytest.mark.parametrize(
    ("field", "operator", "value", "want"),
    [
        ("a", "equals", "x", [True, False, False]),
        ("a", "not_equals", "x", [False, True, True]),
        ("n", "equals", 5, [True, False, False]),
        ("n", "equals", "5", [False, False, False]),
        ("a", "equals", None, [False, False, True]),
        ("n", "gt", 4, [True, False, False]),
        ("n", "gte", 5, [True, False, False]),
        ("n", "lt", 5, [False, True, False]),
        ("n", "lte", 5, [True, True, False]),
        ("a", "gt", 1, [False, False, False]),
        ("a", "is_null", None, [False, False, True]),
        ("a", "not_null", None, [True, True, False]),
        ("a", "contains", "X", [True, False, False]),
        ("n", "contains", "5", [False, False, False]),
        ("f", "equals", True, [True, False, False]),
        ("n", "equals", True, [True, True, False]),
        ("a", "like", "x", [False, False, False]),
        ("gone", "is_null", None, [True, True, True]),
        ("gone", "not_null", None, [False, False, False]),
        ("gone", "equals", "x", [False, False, False]),
        ("enrichment.tool", "equals", "t", [True, False, False]),
    ],
)
def test_operators(spark, field, operator, value, want):
    rows = [(0, "x", 5, True, "t"), (1, "", 2, False, ""), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, n int, f boolean, en_tool string")
    condition = K.condition_column(df, {"field": field, "operator": operator, "value": value})
    assert [r[0] for r in df.orderBy("i").select(condition).collect()] == want


def test_all_rules_and_their_order(spark):
    lead = ("1", "A", "agency", "https://a.org", 4.5, 25, 0, "new")
    scored = K.score_leads(*tables(spark, [lead], [("1", "valid"), ("1", "invalid")], [("1", True, None, "l", None)]), load_rules())
    row = scored.first()
    assert (row.total_score, row.tier, row.tier_label) == (90, "hot", "Hot Lead")
    assert [r.rule_id for r in row.applied_rules] == [
        "business_type_agency", "has_website", "multiple_tutors", "no_scheduling_tool", "high_google_rating",
        "established_reviews", "verified_email", "has_social_presence",
    ]
    assert sum(r.points for r in row.applied_rules) == 90


def test_clamping_and_explanation(spark):
    def rules(points):
        return {"rules": [{"id": "r", "name": "Rule", "condition": {"field": "website", "operator": "not_null"}, "points": points}], "maxScore": 100}

    lead = ("1", "A", None, "", None, None, 0, "new")
    for points, want in ((250, 100), (-5, 0), (40, 40)):
        row = K.explanation(K.score_leads(*tables(spark, [lead]), rules(points))).first()
        assert row.total_score == want
        sign = "+" if points >= 0 else ""
        assert row.explanation == f'Score for "A": {want}/100 ({row.tier_label})\n\nApplied Rules:\n  - Rule: {sign}{points} points\n'
    bare = ("1", "A", None, None, None, None, 0, "new")
    row = K.explanation(K.score_leads(*tables(spark, [bare]), rules(5))).first()
    assert row.explanation.endswith("  - No scoring rules matched\n")


def test_tiers(spark):
    df = spark.createDataFrame([(n,) for n in (0, 29, 30, 49, 50, 69, 70, 100)], "s int")
    got = [r[0] for r in df.orderBy("s").select(K.tier_column(F.col("s"))).collect()]
    assert got == ["cold", "cold", "cool", "cool", "warm", "warm", "hot", "hot"]


def test_summary_of_nothing(spark):
    scored = K.score_leads(*tables(spark, []), load_rules())
    assert K.score_summary(scored).first().asDict() == {"scored": 0, "avg_score": 0.0, "hot": 0, "warm": 0, "cool": 0, "cold": 0}


def test_saving_moves_only_new_leads(spark):
    leads = [("1", "A", None, None, None, None, 3, "new"), ("2", "B", None, None, None, None, 4, "contacted")]
    frames = tables(spark, leads)
    saved = K.save_scores(frames[0], K.score_leads(*frames, load_rules())).orderBy("id")
    assert [(r.score, r.pipeline_stage) for r in saved.collect()] == [(15, "scored"), (15, "contacted")]


def test_rule_file(tmp_path):
    file = tmp_path / "rules.json"
    file.write_text(json.dumps({"rules": []}))
    with pytest.raises(ValueError, match="maxScore"):
        load_rules(file)
    assert len(load_rules()["rules"]) == 10
