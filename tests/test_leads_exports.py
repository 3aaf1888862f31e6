from __future__ import annotations

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contactmill import schemas
from contactmill.operators import leads as L
from contactmill.operators import snapshots as U
from contactmill.sources import exports, tables


@pytest.fixture(scope="module")
def crm(spark):
    leads = spark.createDataFrame(
        [("1", 'A, "quoted"', "x", 80), ("2", "line\nbreak", None, 55), ("3", "C", "y", 0), ("4", "D", None, 10)],
        "id string, business_name string, website string, score int",
    )
    for name, kind in (("business_type", "string"), ("phone", "string"), ("address", "string"), ("city", "string"), ("state_province", "string"),
                       ("country", "string"), ("google_rating", "double"), ("google_review_count", "int"), ("pipeline_stage", "string"),
                       ("source", "string"), ("created_at", "timestamp")):
        leads = leads.withColumn(name, F.lit(None).cast(kind))
    emails = spark.createDataFrame(
        [("e1", "1", "a@s.org", "owner", "valid", False), ("e2", "1", "b@s.org", "info", "catch_all", True), ("e3", "2", "c@s.org", "info", "invalid", False)]
        + [(f"m{i:03}", "3", f"u{i}@s.org", "info", "valid", i == 7) for i in range(100)],
        "id string, lead_id string, email string, role string, verification_status string, is_primary boolean",
    )
    enrichment = spark.createDataFrame(
        [("1", True, "acuity", None, None, ["math", "sat"], 1)],
        "lead_id string, has_multiple_tutors boolean, existing_scheduling_tool string, linkedin_url string, facebook_url string, specialties array<string>, enrichment_attempts int",
    )
    return leads, emails, enrichment


def test_csv_round_trip(crm, tmp_path):
    rows = exports.flat_leads(*crm).orderBy("id").coalesce(1)
    exports.write_csv(rows, str(tmp_path / "out"))
    (file,) = Path(tmp_path / "out").glob("*.csv")
    with open(file, newline="") as f:
        read = list(csv.DictReader(f))
    assert list(read[0]) == exports.FLAT_COLUMNS
    first = {k: read[0][k] for k in ("business_name", "email", "email_verified", "tier", "has_multiple_tutors", "scheduling_tool", "specialties")}
    assert first == {"business_name": 'A, "quoted"', "email": "b@s.org", "email_verified": "catch_all", "tier": "hot",
                     "has_multiple_tutors": "yes", "scheduling_tool": "acuity", "specialties": '["math","sat"]'}
    assert read[1]["business_name"] == "line\nbreak" and read[1]["email"] == "c@s.org" and read[1]["phone"] == ""
    assert (read[3]["email"], read[3]["email_verified"], read[3]["tier"]) == ("", "none", "cold")
    assert file.read_text().splitlines()[1].startswith('1,"A, ""quoted""",')


def test_nested_export_is_whole_for_a_large_lead(crm, tmp_path):
    rows = exports.nested_leads(*crm, per_row=40)
    by_part = {(r.id, r.part): len(r.emails) for r in rows.collect()}
    assert by_part[("1", 0)] == 2 and by_part[("4", 0)] == 0
    large = {k: n for k, n in by_part.items() if k[0] == "3"}
    assert sum(large.values()) == 100 and len(large) > 1 and max(large.values()) <= 40
    exports.write_json(exports.nested_leads(*crm).coalesce(1), str(tmp_path / "out"))
    (file,) = Path(tmp_path / "out").glob("*.json")
    read = {r["id"]: r for r in map(json.loads, file.read_text().splitlines())}
    assert [e["email"] for e in read["1"]["emails"]] == ["b@s.org", "a@s.org"]
    assert read["1"]["enrichment"]["specialties"] == ["math", "sat"] and read["2"]["enrichment"] is None
    assert read["3"]["emails"][0]["email"] == "u7@s.org" and len(read["3"]["emails"]) == 100


def test_search_has_no_wildcards(crm):
    assert [r.id for r in L.search(crm[0], 'A, "Q').collect()] == ["1"]
    assert L.search(crm[0], "%").count() == 0 and L.search(crm[0], "").count() == 4


def test_counts_list_every_status(crm):
    counted = {r.verification_status: r.n for r in L.email_status_counts(crm[1]).collect()}
    assert counted == {"valid": 101, "invalid": 1, "catch_all": 1, "unknown": 0, "unverified": 0}


def test_unknown_filter(crm):
    with pytest.raises(ValueError, match="unknown lead filter"):
        L.filtered("nope", *crm, crm[1], "2024-01-01")


def test_patch_writes_null_only_where_given(spark, crm):
    changes = spark.createDataFrame([("e1", None, True), ("e2", None, False), ("e3", "admin", True)], "id string, role string, given boolean")
    out = {r.id: r.role for r in U.patch(crm[1], changes, "id", ["role"], {"role": "given"}).collect()}
    assert (out["e1"], out["e2"], out["e3"], out["m001"]) == (None, "info", "admin", "info")
    kept = U.patch(crm[1], changes, "id", ["role"])
    assert {r.id: r.role for r in kept.collect()}["e1"] == "owner" and kept.count() == crm[1].count()


def test_added_emails(spark, crm):
    wanted = spark.createDataFrame([("4", " Z@s.org"), ("4", "A@s.org"), ("1", "n@s.org"), ("9", "x@s.org"), ("1", "")], "lead_id string, email string")
    got = {(r.lead_id, r.email, r.is_primary, r.role) for r in L.add_emails(crm[1], crm[0], wanted, "2024-01-01").collect()}
    assert got == {("4", "a@s.org", True, "unknown"), ("4", "z@s.org", False, "unknown"), ("1", "n@s.org", False, "unknown")}


def test_pages_of_a_listing(crm):
    assert L.pagination(crm[0], 1, 3).first().asDict() == {"page": 1, "limit": 3, "total": 4, "total_pages": 2}
    assert [r.id for r in L.page(crm[0], 2, 3).collect()] == ["3"]


def test_tables_round_trip_and_bucketing(spark, crm, tmp_path):
    tables.append(crm[1].withColumn("created_at", F.current_timestamp()), str(tmp_path), "lead_emails")
    back = tables.read_table(spark, str(tmp_path), "lead_emails")
    assert back.count() == crm[1].count() and tables.same_schema(back, "lead_emails")
    assert back.schema == schemas.LEAD_EMAILS
    spark.sql(f"CREATE DATABASE IF NOT EXISTS b LOCATION '{tmp_path}/warehouse'")
    try:
        tables.write_bucketed(crm[0], "leads", "b.leads", 4)
        tables.write_bucketed(crm[1], "lead_emails", "b.emails", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = L.with_valid_email(spark.table("b.leads"), spark.table("b.emails"))
        assert sorted(r.id for r in joined.collect()) == ["1", "3"]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE b CASCADE")
