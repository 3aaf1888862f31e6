from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import Row

from contactmill.functions import features as X
from contactmill.operators import ingest as B
from contactmill.operators import verify as D
from contactmill.sources import files, tables

PLACE = "run_id string, seq int, place_id string, name string, city string, state_province string, country string, business_status string"
KNOWN = "id string, business_name string, city string, state_province string, source string, source_id string"


def ingest(spark, places, known=()):
    found = B.operational_places(spark.createDataFrame(places, PLACE))
    leads = spark.createDataFrame(list(known), KNOWN)
    new = B.new_places(found, leads)
    counters = {r.run_id: (r.leads_found, r.leads_new, r.leads_duplicate) for r in B.run_counters(found, leads, new).collect()}
    return sorted(r.seq for r in new.collect()), counters


def test_each_step_of_ingest(spark):
    places = [
        ("a", 1, "P1", "Alpha", "X", "NY", "US", None),
        ("a", 2, "P1", "Alpha again", "X", "NY", "US", None),  # repeated id in the run
        ("a", 3, "P2", "Closed", "X", "NY", "US", "CLOSED_TEMPORARILY"),
        ("a", 4, "P3", " ALPHA ", "X", "NY", "US", "OPERATIONAL"),  # same name and place
        ("a", 5, "P4", "Alpha", None, "NY", "US", "OPERATIONAL"),  # a null city is a value
        ("a", 6, "P5", "alpha", None, "NY", "US", "OPERATIONAL"),
        ("a", 7, "P6", "Alpha", "", "NY", "US", "OPERATIONAL"),
        ("a", 8, "P7", "Beta", "X", "NY", "MX", "OPERATIONAL"),  # other country
        ("a", 9, "P8", "Gamma", "X", "NY", None, "OPERATIONAL"),
        ("a", 10, "K1", "Delta", "X", "NY", "US", "OPERATIONAL"),  # known id
        ("a", 11, "P9", "Known Name", "X", None, "CA", "OPERATIONAL"),
        ("b", 12, "P1", "Alpha", "X", "NY", "US", None),  # again in a later run
        ("b", 13, "P10", "Omega", "X", "NY", "US", None),
    ]
    known = [("1", "Old", "Q", "NY", "google_maps", "K1"), ("2", "known name", "X", None, "yelp", "P10")]
    new, counters = ingest(spark, places, known)
    assert new == [1, 5, 7, 13]
    assert counters == {"a": (9, 3, 4), "b": (2, 1, 1)}


def test_ingest_twice_adds_nothing(spark):
    places = [("a", i, f"P{i % 7}", f"N{i % 5}", "X", "NY", "US", None) for i in range(40)]
    df = spark.createDataFrame(places, PLACE)
    none = spark.createDataFrame([], KNOWN)
    leads = B.to_leads(B.new_places(B.operational_places(df), none), "2024-01-01")
    assert leads.count() == 5
    assert B.new_places(B.operational_places(df), leads).count() == 0


def test_address_components(spark):
    def part(long, short, *types):
        return Row(long_name=long, short_name=short, types=list(types))

    rows = [
        (1, [part("A", "a", "locality", "administrative_area_level_1"), part("B", "b", "locality"), part("New York", "NY", "administrative_area_level_1"), part("United States", "US", "country")]),
        (2, [part("Mexico", "MX", "country"), part("Canada", "CA", "country"), part("Chile", "CL", "country")]),
        (3, []),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "i int, c array<struct<long_name:string,short_name:string,types:array<string>>>")
    got = [tuple(r[0]) for r in df.orderBy("i").select(B.parse_address(F.col("c"))).collect()]
    assert got == [("B", "NY", "US"), (None, None, "CA"), (None, None, None), (None, None, None)]


def test_business_types(spark):
    rows = [
        (1, "Kumon Online Academy", None, "franchise"), (2, "Virtual School", None, "online_platform"),
        (3, "Math Centre", None, "agency"), (4, "Jo Doe", ["point_of_interest", "establishment"], "agency"),
        (5, "Jo Doe", ["establishment"], "solo_tutor"), (6, "Jo Doe", None, "solo_tutor"),
    ]
    df = spark.createDataFrame(rows, "i int, n string, t array<string>, want string")
    assert df.filter(X.business_type(F.col("n"), F.col("t")) != F.col("want")).count() == 0


def test_place_files(spark, tmp_path):
    search = {"status": "OK", "results": [{"place_id": "P1", "name": "s", "business_status": "OPERATIONAL"}, {"place_id": "P2"}]}
    (tmp_path / "search").mkdir()
    (tmp_path / "search/a.json").write_text(json.dumps(search))
    (tmp_path / "search/b.json").write_text(json.dumps({**search, "status": "OVER_QUERY_LIMIT"}))
    (tmp_path / "search/c.json").write_text(json.dumps({"status": "ZERO_RESULTS", "results": []}))
    detail = {
        "place_id": "P1", "name": "Alpha", "types": ["establishment"],
        "address_components": [{"long_name": "X", "short_name": "x", "types": ["locality"]}, {"long_name": "U", "short_name": "US", "types": ["country"]}],
    }
    (tmp_path / "details").mkdir()
    (tmp_path / "details/a.json").write_text(json.dumps({"status": "OK", "result": detail}))
    found = files.read_places(spark, str(tmp_path / "search"))
    assert [(r.pos, r.place_id) for r in found.orderBy("pos").collect()] == [(0, "P1"), (1, "P2")]
    records = files.place_records(found, files.read_place_details(spark, str(tmp_path / "details")), "run")
    new = B.new_places(B.operational_places(records), spark.createDataFrame([], KNOWN))
    (lead,) = B.to_leads(new, "2024-01-01").collect()
    assert (lead.business_name, lead.city, lead.country, lead.source_id, lead.score) == ("Alpha", "X", "US", "P1", 0)


def test_manual_leads_and_runs(spark):
    wanted = spark.createDataFrame([("A", "", "x"), ("", "w", "x"), (None, "w", "x")], "business_name string, website string, city string")
    (lead,) = B.manual_leads(wanted, "2024-01-01").collect()
    assert (lead.website, lead.city, lead.source, lead.pipeline_stage) == (None, "x", "manual", "new")
    runs = B.start_runs(spark.createDataFrame([("1", "s", "q", None), ("2", "s", "q", "l"), ("3", "s", "q", "l")], "id string, source string, query string, location string"), "2024-01-01")
    results = spark.createDataFrame([("1", 5, 3, 2, None), ("2", 9, 9, 9, "boom")], "id string, leads_found long, leads_new long, leads_duplicate long, error_message string")
    done = {r.id: (r.status, r.leads_found, r.completed_at is not None) for r in B.finish_runs(runs, results, "2024-01-02").collect()}
    assert done == {"1": ("completed", 5, True), "2": ("failed", 0, True), "3": ("running", 0, False)}


def test_checks_and_defaults(spark):
    rows = spark.createDataFrame(
        [("1", "9", " JO@S.org ", "owner", None), ("2", "9", None, "owner", None), ("3", "9", "a@b.c", "boss", "valid"), ("4", "9", "a@b.c", None, None)],
        "id string, lead_id string, email string, role string, verification_status string",
    ).withColumn("created_at", F.current_timestamp())
    good, bad = tables.check_rows(tables.with_defaults(rows, "lead_emails"), "lead_emails")
    got = [(r.id, r.email, r.verification_status, r.is_primary) for r in good.orderBy("id").collect()]
    assert got == [("1", "jo@s.org", "unverified", False), ("4", "a@b.c", "unverified", False)]
    assert {r.id: r.reasons for r in bad.collect()} == {"2": ["email is missing"], "3": ["role has an unknown value"]}


def test_same_phone_or_domain(spark):
    rows = [
        ("1", "(555) 1-2", "a.com"), ("2", "5551 2", None), ("3", None, "https://shop.a.com/x"), ("4", None, None),
        ("5", "", "b.org"), ("6", "77", "http://www.b.org"), ("7", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, phone string, website string")
    assert sorted(r.id for r in B.drop_same_contact(df).collect()) == ["1", "4", "5", "7"]


def test_verification_decisions(spark):
    cases = [
        ("a", "x@ok.org", 250, 3, False, None, False, "valid", None),
        ("b", "x@ok.org", 251, 3, False, None, True, "catch_all", None),
        ("c", "x@ok.org", 550, 3, False, None, False, "invalid", None),
        ("d", "x@ok.org", 450, 3, False, None, False, "unknown", "Temporary failure"),
        ("e", "x@ok.org", 554, 3, False, None, False, "invalid", None),
        ("f", "x@ok.org", None, 1, True, None, False, "unknown", "SMTP timeout"),
        ("g", "x@ok.org", 421, 0, False, None, False, "unknown", "SMTP error: 421"),
        ("h", "x@ok.org", None, 0, False, "refused", False, "unknown", "refused"),
        ("i", "none", 250, 3, False, None, False, "invalid", "Invalid email format"),
        ("j", "x@YOPMAIL.com", 250, 3, False, None, False, "invalid", "Disposable email domain"),
        ("k", "x@nomx.org", 250, 3, False, None, False, "invalid", "No MX records found"),
        ("l", None, 250, 3, False, None, False, "invalid", "Invalid email format"),
    ]
    probes = spark.createDataFrame(
        [(c[0], *c[2:7]) for c in cases], "email_id string, code int, step int, timed_out boolean, socket_error string, catch_all_accepted boolean"
    )
    emails = spark.createDataFrame([(c[0], c[1]) for c in cases] + [("z", "x@ok.org")], "id string, email string")
    mx = spark.createDataFrame([("ok.org", "m2", 20), ("OK.org", "m1", 10), ("yopmail.com", "y", 1)], "domain string, exchange string, priority int")
    got = {r.id: (r.new_status, r.error) for r in D.verify(emails, probes, mx).collect()}
    assert got == {**{c[0]: (c[7], c[8]) for c in cases}, "z": ("unknown", None)}
    assert {r.domain: r.primary_mx for r in D.primary_mx(mx).collect()} == {"ok.org": "m1", "yopmail.com": "y"}
