"""Numbers by ranges, sums by blocks, deep pages and the search index, against the plain ways."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactmill.operators import leads as L
from contactmill.operators import search as S
from contactmill.operators.running import numbered, sum_ahead
from contactmill.session import scratch


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def scored(spark):
    """A third of the rows share one score, and some have none."""
    score = F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id * 37 % 101 END")
    return spark.range(0, 2000, 1, 7).select(F.col("id"), score.alias("score"))


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_numbers_are_those_of_one_sort(scored, ranges):
    order = [F.desc("score"), F.col("id")]
    want = scored.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    assert rows_of(numbered(scored, order, ranges=ranges)) == rows_of(want)


def test_numbers_of_no_rows(scored):
    assert numbered(scored.where("id < 0"), [F.col("id")]).collect() == []


def test_equal_rows_get_different_numbers(spark):
    same = spark.range(50).select(F.lit(1).alias("a"))
    assert sorted(r.rank for r in numbered(same, [F.col("a")], ranges=4).collect()) == list(range(1, 51))


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_sums_ahead_by_blocks(scored, block):
    rows = scored.withColumn("rank", F.row_number().over(W.orderBy("id")))
    ahead = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    want = rows.withColumn("s", F.coalesce(F.sum("score").over(ahead), F.lit(0)))
    assert rows_of(sum_ahead(rows, F.col("score"), "s", block=block)) == rows_of(want)


def test_a_numbered_plan_moves_rows_once_and_has_no_single_task_over_them(scored):
    plan = numbered(scored, [F.desc("score"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan")
    single = plan.find("SinglePartition")
    # The only single task is over the totals of the ranges, after they were added up.
    assert single >= 0 and "HashAggregate" in plan[single:] and scan >= 0
    assert plan.count("SinglePartition") == 1


@pytest.mark.parametrize("number", [1, 2, 13, 28, 40, 41, 10_000])
def test_pages_by_their_starts(scored, number):
    starts = L.page_starts(scored, 50)
    got = [tuple(r) for r in L.page_from(scored, starts, number, 50).collect()]
    assert got == [tuple(r) for r in L.page(scored, number, 50).collect()]


def test_a_deep_page_is_a_top_k_of_its_own_length(spark, scored):
    starts = L.page_starts(scored, 50)
    plan = L.page_from(scored, starts, 30, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=50" in plan


LEADS = [
    (1, "Alpha Tutors", "Oslo", "https://alpha.example"), (2, "beta", None, None), (3, None, "OSLO west", "x"),
    (4, "", "", ""), (5, "100% (A_b)", "Ωmega \U0001f600\U0001f601\U0001f602 town", "https://a.b?c=d"), (6, "aaaa", "é", "aaaaab"),
    (7, "Long " * 5000 + "needle", "Oslo", None), (8, "line\nbreak", "tab\tbed", "a'b\"c"),
]
TERMS = ["", "a", "o", "os", "oslo", "OSLO W", "alpha", "aaa", "aaab", "aaaaa", "needle", "g n", "%", "% (", "a_b", "e\nb", "b\tb", "'b\"", "\U0001f600\U0001f601\U0001f602", "mega \U0001f600", "zzz", "town beta", "https://"]


@pytest.fixture(scope="module")
def leads(spark):
    return spark.createDataFrame(LEADS, "id long, business_name string, city string, website string")


@pytest.fixture(scope="module")
def index(spark, leads, tmp_path_factory):
    return S.LeadIndex.create(leads, str(tmp_path_factory.mktemp("index") / "i"), 8)


@pytest.mark.parametrize("term", TERMS)
def test_index_finds_what_a_scan_finds(index, leads, term):
    assert rows_of(index.search(term)) == rows_of(L.search(leads, term))


def test_changes_of_the_index(spark, leads):
    index = S.LeadIndex.create(leads, scratch(spark), 8)
    new = spark.createDataFrame([(1, "Gamma", "Oslo", None), (9, "Tutors too", None, "alpha"), (9, "Tutors too", None, "alpha")], leads.schema)
    index.put(new)
    index.put(new)
    index.remove(spark.createDataFrame([(3,), (77,)], "id long"))
    now = leads.where("id NOT IN (1, 3)").unionByName(new.distinct())
    for term in TERMS + ["gamma", "tutors", "alpha tutors"]:
        assert rows_of(index.search(term)) == rows_of(L.search(now, term)), term
    # No gram is left of what went, and none is missing of what came.
    assert rows_of(index.grams.read().select("gram", "id")) == rows_of(S.grams_of(now).select("gram", "id"))


def test_an_interrupted_put_leaves_searches_right(spark, leads):
    index = S.LeadIndex.create(leads, scratch(spark), 8)
    new = spark.createDataFrame([(2, "Delta", "Rome", None)], leads.schema)
    index.grams.merge(S.grams_of(new), lambda rows, more: rows.unionByName(more).distinct())
    assert rows_of(index.search("delta")) == [] and len(rows_of(index.search("beta"))) == 1
    index.put(new)
    assert [r[0] for r in rows_of(index.search("delta"))] == [2] and rows_of(index.search("beta")) == []


def test_a_search_reads_the_buckets_of_its_grams(spark, leads):
    many = leads.unionByName(
        spark.range(100, 400).selectExpr("id", "concat('name', id) business_name", "cast(null as string) city", "cast(null as string) website")
    )
    index = S.LeadIndex.create(many, scratch(spark), 64)
    plan = index.search("name123")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan)


def test_an_empty_index(spark, leads):
    index = S.LeadIndex.create(leads.limit(0), scratch(spark), 4)
    assert index.search("oslo").collect() == [] and index.search("o").collect() == []
