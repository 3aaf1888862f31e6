"""The plans that matter at scale: join kinds, top-k, group limits, pruning and push-down."""

from __future__ import annotations

import re

import pytest

from contactmill.operators import leads as L
from contactmill.operators import pages as P
from contactmill.operators import sendlog as H
from contactmill.plans import queries as Q
from contactmill.plans.views import Tables


@pytest.fixture(scope="module")
def t(spark, small):
    return Tables(spark, small)


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_existence_tests_are_semi_and_anti_joins(t):
    assert "LeftSemi" in plan_of(L.with_valid_email(t.leads, t.lead_emails))
    assert "LeftAnti" in plan_of(L.without_emails(t.leads, t.lead_emails))
    plan = plan_of(H.outreach_eligible(t.leads, t.lead_emails, t.send_log, t.sequence_enrollments, 100))
    assert plan.count("LeftAnti") == 2 and "TakeOrderedAndProject" in plan


def test_first_per_key_limits_groups_before_the_shuffle(t):
    for df in (L.best_email(t.lead_emails), L.primary_email(t.lead_emails), Q.ingest_dedup(t)):
        plan = plan_of(df)
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_page_bodies_are_not_shuffled_by_the_page_limit(t):
    plan = plan_of(P.first_pages_per_site(P.with_site(t.pages), 12))
    assert "BroadcastHashJoin" in plan
    window_side = plan[plan.index("WindowGroupLimit"):]
    assert "html" not in window_side.split("FileScan")[-1].split("ReadSchema")[-1]


def read_columns(plan: str, table: str) -> set[str]:
    """Columns any scan of a table reads."""
    schemas = re.findall(rf"{table}\.parquet.*?ReadSchema: struct<([^>]*)>", plan)
    return {field.split(":")[0] for schema in schemas for field in schema.split(",")}


def test_scoring_reads_only_what_the_rules_need(t):
    plan = plan_of(Q.score_summary(t))
    assert read_columns(plan, "customer") == {"c_custkey", "c_mktsegment", "c_nationkey"}
    assert "o_orderdate" not in read_columns(plan, "orders")


def test_filters_reach_the_scan(t):
    plan = plan_of(H.history_of_lead(t.send_log, 7))
    assert "EqualTo(user_id,7)" in plan


def test_statistics_read_each_table_once(t):
    """All flags come from one pass: leads, e-mails, sends and enrichment are read once each."""
    for df in (Q.listing_filter_counts(t), Q.extended_stats(t)):
        plan = plan_of(df)
        scans = {name: len(re.findall(rf"Location: [^\n]*{name}\.parquet", plan)) for name in ("customer", "events", "orders")}
        # The sample e-mails read orders twice, the enrichment once.
        assert scans == {"customer": 1, "events": 1, "orders": 3}


def test_parts_of_a_large_lead_are_spread(t, no_broadcast):
    plan = plan_of(Q.export_nested(t))
    assert "REPARTITION_BY_COL" in plan
    # The gathered arrays and the leads meet by lead and part, without another shuffle of arrays.
    after = plan[: plan.index("REPARTITION_BY_COL")]
    assert "hashpartitioning(id" in after and "part" in after


def test_joins_by_lead_share_one_partitioning(t, no_broadcast):
    plan = plan_of(Q.score_leads(t))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(n for n in Q.registered() if not n.startswith("stream_")))
def test_no_query_multiplies_rows(spark, small, name):
    """No cross or nested-loop join anywhere."""
    plan = plan_of(Q.registered()[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
