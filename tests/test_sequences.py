from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contactmill.functions import features as X
from contactmill.operators import replies as R
from contactmill.operators import sendlog as H
from contactmill.operators import sequences as G
from contactmill.operators import templates as M
from contactmill.sources import files


def variables(**values):
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.array(*pairs))


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("Hi {{name}}!", "Hi Jo!"),
        ("{{name}}{{name}} {{nobody}}", "JoJo {{nobody}}"),
        ("a{{#if name}} {{name}}{{/if}}b", "a Job"),
        ("a{{#if nobody}} x{{/if}}b", "ab"),
        ("a{{#if empty}} x{{/if}}b{{empty}}", "ab"),
        ("{{#unless name}}x{{/unless}}{{#unless nobody}}y\nz{{/unless}}", "y\nz"),
        ("{{#if name}}1{{/if}} {{#if name}}2{{/if}}", "1 2"),
        ("{{#if name}}1{{#if nobody}}2{{/if}}3{{/if}}", "1{{#if nobody}}23{{/if}}"),
        ("{{#if  name}}1{{/if}}", "1"),
        ("{{#if name}}open", "{{#if name}}open"),
        ("  x \n", "x"),
        ("{{money}} {{tag}}", "$1\\2 {{name}}"),
        ("", ""),
        ("{{name", "{{name"),
    ],
)
def test_render(one, template, want):
    values = variables(name="Jo", empty="", money="$1\\2", tag="{{name}}")
    assert one(M.render(F.lit(template), values)) == want


@pytest.mark.parametrize(
    ("template", "errors"),
    [
        ("Hi {{name}} {{#if a}}x{{/if}}", []),
        ("Hi {{name}", ["Mismatched braces: 1 opening vs 0 closing"]),
        ("{{#if a}}x", ["Unclosed {{#if}} blocks: 1 opens vs 0 closes"]),
        ("{{#unless a}}x{{/if}}", ["Unclosed {{#if}} blocks: 0 opens vs 1 closes", "Unclosed {{#unless}} blocks: 1 opens vs 0 closes"]),
    ],
)
def test_template_errors(one, template, errors):
    assert one(M.template_errors(F.lit(template))) == errors


@pytest.mark.parametrize(
    ("kind", "name", "want"),
    [("solo_tutor", "Ann's Tutoring", "Ann"), ("solo_tutor", "Ann Lee", "Ann"), ("solo_tutor", "ann lee", None),
     ("solo_tutor", "Annie-Lee", None), ("agency", "Ann Lee", None), (None, "Ann Lee", None)],
)
def test_first_name(one, kind, name, want):
    assert one(M.first_name(F.lit(kind).cast("string"), F.lit(name))) == want


def test_openings_and_steps(spark):
    schema = "lead_id string, business_name string, business_type string, city string, state_province string, website string, google_rating double, google_review_count int, has_multiple_tutors boolean, specialties array<string>"
    full = ("1", "Ann Lee", "solo_tutor", "X", "NY", "w", 5.0, 10, True, ["math", "sat", "act", "gre"])
    bare = ("2", "Bob", "agency", "", "NY", None, 4.4, 99, None, [])
    df = spark.createDataFrame([full, bare], schema)
    lines = {r[0]: r[1] for r in df.select("lead_id", M.openings(df)).collect()}
    assert lines["1"] == [
        "I noticed you're helping students in the X area", "Your focus on math tutoring caught my attention",
        "I saw your excellent 5-star rating from 10 reviews", "I see you have a team of tutors working with students",
    ]
    assert lines["2"] == ["I came across Bob while researching tutoring businesses"]
    steps = df.crossJoin(
        spark.createDataFrame([(1, "{{first_name}} {{specialties}}", "{{personalized_opening}}."), (2, "{{city}}", "{{personalized_opening}}")],
                              "step_number int, subject_template string, body_template string"))
    got = {(r.lead_id, r.step_number): (r.subject, r.body) for r in M.render_steps(steps).collect()}
    assert got["1", 1][0] == "Ann math, sat, act" and got["1", 1][1][:-1] in lines["1"]
    assert got["2", 1] == ("{{first_name}} {{specialties}}", lines["2"][0] + ".")
    assert got["1", 2] == ("X", "{{personalized_opening}}") and got["2", 2][0] == "{{city}}"


def test_strip_html(one):
    html = "<p>Hi&nbsp;&lt;Jo&gt;</p><BR/>\n\n\n<b>a &amp; b</b></P> "
    assert one(X.strip_html(F.lit(html))) == "Hi <Jo>\n\na & b"


def test_sequence_file_numbers_steps_by_place(spark, tmp_path):
    steps = [{"step_number": 9, "delay_hours": 0, "subject_template": "a", "body_template": "b"}, {"step_number": 1, "subject_template": "c", "body_template": "d"}]
    (tmp_path / "s.json").write_text(json.dumps({"name": "Intro", "steps": steps}))
    sequences, rows = files.read_sequence_files(spark, str(tmp_path), "2024-01-01")
    assert [(r.name, r.total_steps, r.status) for r in sequences.collect()] == [("Intro", 2, "active")]
    assert [(r.step_number, r.delay_hours, r.subject_template) for r in rows.orderBy("step_number").collect()] == [(1, 0, "a"), (2, 0, "c")]


@pytest.mark.parametrize(
    ("at", "limit"),
    [("2025-01-14 23:59:59", 0), ("2025-01-15", 25), ("2025-01-17", 25), ("2025-01-18", 50), ("2025-02-12", 100), ("2025-02-13", 15)],
)
def test_warmup(one, at, limit):
    rules = G.SendingRules(warmup_start="2025-01-15")
    assert one(G.daily_limit(F.lit(at), rules)) == limit


def test_limit_without_warmup_or_schedule(one):
    now = F.lit("2025-01-20")
    assert one(G.daily_limit(now, G.SendingRules(daily_limit=7))) == 7
    assert one(G.daily_limit(now, G.SendingRules(daily_limit=7, warmup_start="2025-01-15", warmup_schedule=()))) == 7
    assert one(G.daily_limit(now, G.SendingRules(warmup_start="2025-01-20", warmup_schedule=[(9, 3), (5, 2)]))) == 2


@pytest.mark.parametrize(
    ("at", "inside"),
    [("2024-07-01 12:00", True), ("2024-07-01 11:59", False), ("2024-07-01 21:59", True), ("2024-07-01 22:00", False),
     ("2024-01-01 12:00", False), ("2024-01-01 13:00", True), ("2024-01-01 05:00", False)],
)
def test_window_follows_the_clock_changes(one, at, inside):
    assert one(G.in_sending_window(F.lit(at).cast("timestamp"), G.SendingRules())) is inside


def log(spark, *counts):
    rows = [(f"{s}{i}", s, "2024-01-10 09:00:00") for s, n in counts for i in range(n)]
    df = spark.createDataFrame(rows, "id string, status string, sent_at string")
    return df.withColumn("sent_at", F.col("sent_at").cast("timestamp")).withColumn("sequence_id", F.lit(None).cast("string"))


@pytest.mark.parametrize(
    ("counts", "pause", "reason"),
    [
        ([("sent", 8), ("bounced", 1)], False, None),
        ([("sent", 8), ("bounced", 1), ("opened", 50)], False, None),
        ([("sent", 18), ("bounced", 1)], True, "Bounce rate 5.3% exceeds 5% threshold"),
        ([("sent", 19), ("bounced", 1)], False, None),
        ([("sent", 9), ("bounced", 1)], True, "Bounce rate 10% exceeds 5% threshold"),
        ([("sent", 20), ("complained", 1)], True, "Complaint rate 4.8% exceeds 0.1% threshold"),
        ([("delivered", 999), ("complained", 1)], False, None),
        ([("sent", 30)], False, None),
        ([("sent", 0)], False, None),
    ],
)
def test_breaker(spark, counts, pause, reason):
    row = H.breaker(log(spark, *counts), "2024-01-10 12:00:00").first()
    assert (row.pause, row.reason) == (pause, reason)
    assert H.breaker(log(spark, *counts), "2024-01-12 12:00:00").first().pause is False


def test_send_stats_of_an_empty_log(spark):
    row = H.send_stats(log(spark), "2024-01-10").first().asDict()
    assert set(row.values()) == {0, 0.0}


ENROLLMENTS = "id int, lead_id int, sequence_id int, email_id int, current_step int, status string, next_send_at timestamp, completed_at timestamp"


@pytest.fixture()
def mailing(spark):
    day = datetime(2024, 1, 1)
    enrollments = spark.createDataFrame(
        [(i, i, 1 if i < 9 else 2, i, step, "active", day, None) for i, step in enumerate([0, 1, 2, 3, 0, 0, 0, 0, 0, 0])], ENROLLMENTS
    )
    leads = spark.createDataFrame([(i, f"L{i}", None, "X", "NY") for i in range(10)], "id int, business_name string, website string, city string, state_province string")
    emails = spark.createDataFrame([(i, i, f"e{i}@s.org") for i in range(10)], "id int, lead_id int, email string")
    sequences = spark.createDataFrame([(1, "S", 3, "active"), (2, "T", 3, "paused")], "id int, name string, total_steps int, status string")
    steps = spark.createDataFrame([(1, 1, 0), (1, 2, 48), (1, 3, 24)], "sequence_id int, step_number int, delay_hours int")
    return enrollments, leads, emails, sequences, steps


NOON = "2024-01-10 17:00:00"


def test_plan_keeps_to_the_budget(spark, mailing):
    plan = G.send_plan(*mailing, log(spark, ("sent", 2)), NOON, G.SendingRules(daily_limit=8), limit=50).orderBy("rank").collect()
    assert [(r.id, r.outcome) for r in plan] == [(0, "send"), (1, "send"), (2, "send"), (3, "complete"), (4, "send"), (5, "send"), (6, "hold"), (7, "hold"), (8, "hold")]
    times = [r.planned_at for r in plan if r.outcome == "send"]
    assert times[0] == datetime(2024, 1, 10, 17) and times == sorted(times)
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:], strict=False)]
    assert all(45 <= g <= 240 for g in gaps)


@pytest.mark.parametrize("limit", [None, 200_000])
def test_long_plans_equal_short_ones(spark, mailing, limit):
    args = (*mailing, log(spark, ("sent", 2)), NOON, G.SendingRules(daily_limit=8))
    want = G.send_plan(*args, limit=50)
    got = G.send_plan(*args, limit=limit).select(*want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=lambda r: r.rank) == sorted(want.collect(), key=lambda r: r.rank)


@pytest.mark.parametrize(
    ("counts", "at", "limit", "reason"),
    [
        ([("sent", 5)], NOON, 5, "daily limit reached"),
        ([("sent", 5)], "2024-01-10 03:00:00", 50, "outside sending window"),
        ([("sent", 5), ("bounced", 5)], NOON, 50, "paused: Bounce rate 50% exceeds 5% threshold"),
    ],
)
def test_gates(spark, mailing, counts, at, limit, reason):
    plan = G.send_plan(*mailing, log(spark, *counts), at, G.SendingRules(daily_limit=limit), limit=50)
    assert {(r.outcome, r.hold_reason, r.planned_at) for r in plan.collect()} == {("hold", reason, None)}


def test_due_list_passes_over_missing_leads(spark, mailing):
    enrollments, leads, emails, sequences, _ = mailing
    due = G.due_enrollments(enrollments, leads, emails, sequences, NOON, 4)
    assert [r.id for r in due.collect()] == [0, 1, 2, 3]
    fewer = leads.filter("id <> 1")
    got = G.due_enrollments(enrollments, fewer, emails, sequences, NOON, 4)
    assert [r.id for r in got.collect()] == [0, 2, 3, 4]


def test_booking_results(spark, mailing):
    enrollments, leads, emails, sequences, steps = mailing
    plan = G.send_plan(*mailing, log(spark), NOON, G.SendingRules(daily_limit=50), limit=50)
    outcomes = spark.createDataFrame(
        [(0, True, "m0", None), (1, True, "m1", None), (2, True, "m2", None), (4, False, None, "mailbox invalid"), (5, False, None, "busy"), (6, False, None, "bounced")],
        "id int, success boolean, message_id string, error string",
    )
    sent, after = G.book_results(plan, outcomes, enrollments, sequences, steps, NOON)
    assert {(r.lead_id, r.step_number, r.ses_message_id, r.status) for r in sent.collect()} == {
        (0, 1, "m0", "sent"), (1, 2, "m1", "sent"), (2, 3, "m2", "sent"), (4, 1, None, "bounced"), (5, 1, None, "bounced"), (6, 1, None, "bounced"),
    }
    state = {r.id: (r.current_step, r.status, r.next_send_at and r.next_send_at.day, r.completed_at is not None) for r in after.collect()}
    assert state[0] == (1, "active", 12, False) and state[1] == (2, "active", 11, False)
    assert state[2] == (3, "completed", None, True) and state[3] == (3, "completed", 1, True)
    assert state[4][1] == state[6][1] == "bounced" and state[5] == (0, "active", 1, False) and state[7] == (0, "active", 1, False)
    assert after.count() == enrollments.count()


def test_enrolment_needs_an_active_sequence(spark, mailing):
    *_, sequences, steps = mailing
    eligible = spark.createDataFrame([(1, 11)], "id int, email_id int")
    assert [(r.lead_id, r.next_send_at.hour) for r in G.enroll(eligible, sequences, steps, 1, NOON).collect()] == [(1, 17)]
    assert G.enroll(eligible, sequences, steps, 2, NOON).count() == 0
    assert G.enroll(eligible, sequences, steps, 7, NOON).count() == 0


def test_outreach_renders_literally(spark):
    df = spark.createDataFrame([("$1 & {{business_name}}",)], "business_name string")
    row = H.render_outreach(df, "For {{business_name}} {{business_name}}", "{{business_name}}-{{business_name}}").first()
    assert row.subject == "For $1 & {{business_name}} {{business_name}}"
    assert row.body == "$1 & {{business_name}}-$1 & {{business_name}}"


def test_replies(spark, mailing):
    at = [datetime(2024, 1, d) for d in range(1, 9)]
    sends = spark.createDataFrame(
        [("s1", 1, 1, "m1", at[0]), ("s2", 2, 1, "m2", at[0]), ("s3", 3, 1, "m3", at[0]), ("s9", 9, 2, "m9", at[0])],
        "id string, lead_id int, sequence_id int, ses_message_id string, sent_at timestamp",
    )
    replies = spark.createDataFrame(
        [("r1", "m1", "interested", at[1]), ("r2", "m2", "unsubscribe", at[1]), ("r3", "m2", "interested", at[2]),
         ("r4", "m3", "out_of_office", at[3]), ("r5", "zz", "interested", at[1]), ("r6", "m9", "question", at[1])],
        "reply_id string, ses_message_id string, reply_class string, received_at timestamp",
    )
    effects = R.reply_effects(replies, sends)
    assert effects.count() == 5
    assert {r.id: r.pipeline_stage for r in R.lead_stages(effects).collect()} == {1: "qualified", 2: "unsubscribed", 9: "replied"}
    rows = {r.id: (r.status, r.next_send_at.day) for r in R.apply_to_enrollments(mailing[0], effects, "2024-02-01").collect()}
    assert [rows[i][0] for i in (0, 1, 2, 3, 9)] == ["active", "replied", "unsubscribed", "active", "replied"]
    assert rows[3][1] == 11 and rows[0][1] == 1


TEMPLATES = [
    "", "plain", "{{a}}", "x {{a}} y {{zz}} {{a}}", "{{#if a}}has {{a}}{{/if}}{{#unless a}}none{{/unless}}", " {{b}} ",
    "{{#if b}}B{{/if}}{{#unless zz}}no {{zz}}{{/unless}}", "{{#if a}}open {{a}}", "{{/if}} closed", "{{#if a}}{{#if b}}x{{/if}}{{/if}}",
    "{{#if a}}{{#unless b}}x{{/unless}}{{/if}}", "{{#if {{a}}}}x{{/if}}", "a { b } {{a}}", "{{ a }}", "{{#if  a}}two{{/if}}",
    "{{#if a}}1{{/unless}}2{{/if}}", "{{}}{{a}}", "{{{a}}}", "line\n{{a}}\n\n{{#if a}}\nx\n{{/if}}\n", "{{#if zz}}gone{{/if}}{{a}}{{#if a}}kept{{/if}}",
]
VALUES = [
    {"a": "Ann", "b": ""}, {"a": "", "b": "Bob"}, {}, {"a": "{{b}}", "b": "deep"}, {"a": "b", "b": "{{#if a}}"}, {"a": " s ", "b": "}}"},
]


def test_compiled_templates_render_as_templates_do(spark):
    rows = spark.createDataFrame([(t, v) for t in [None, *TEMPLATES] for v in VALUES], "template string, v map<string,string>")
    segments = rows.withColumn("s", M.compiled(F.col("template")))
    out = segments.select("template", "v", "s", M.render(F.col("template"), F.col("v")).alias("want"), M.render_compiled(F.col("s"), F.col("template"), F.col("v")).alias("got"))
    assert [(r.template, r.v, r.got) for r in out.collect()] == [(r.template, r.v, r.want) for r in out.collect()]
    by_segments = {r.template for r in out.where("s IS NOT NULL").collect()}
    assert {t for t in TEMPLATES if t not in by_segments} == {
        "{{#if a}}open {{a}}", "{{/if}} closed", "{{#if a}}{{#if b}}x{{/if}}{{/if}}", "{{#if a}}{{#unless b}}x{{/unless}}{{/if}}",
        "{{#if {{a}}}}x{{/if}}", "a { b } {{a}}", "{{ a }}", "{{#if a}}1{{/unless}}2{{/if}}", "{{}}{{a}}", "{{{a}}}",
    }
    assert len(segments.where("template = 'x {{a}} y {{zz}} {{a}}'").first().s) == 6


def test_prepared_leads_and_compiled_steps_render_alike(spark):
    steps = spark.createDataFrame([(1, TEMPLATES[3], "{{personalized_opening}} {{city}}"), (2, "{{business_name}}", "{{personalized_opening}}{{#if first_name}}x{{/if}}")], "step_number int, subject_template string, body_template string")
    leads = spark.createDataFrame([(1, "Ann's Maths", "solo_tutor", "Oslo", "N"), (2, "{{city}}", "agency", "", None)], "id long, business_name string, business_type string, city string, state_province string")
    leads = leads.selectExpr("*", "'w' AS website", "cast(null as string) AS specialties", "4.9 AS google_rating", "30L AS google_review_count")
    want = M.render_steps(leads.crossJoin(steps)).select("id", "step_number", "subject", "body")
    got = M.render_steps(M.prepare_leads(leads).crossJoin(M.compile_steps(steps))).select("id", "step_number", "subject", "body")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
