"""Ingest of raw place records: classify, de-duplicate, count.

Records are ``(run_id, seq, place_id, name, city, state_province, country, business_status)``
with optional ``types``, ``address``, ``website``, ``phone``; ``seq`` is the order of arrival.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import columns as C
from contactmill.functions import features as X
from contactmill.functions import fixed_values as fv
from contactmill.operators.suffixes import with_registered_domain


def parse_address(components: Column) -> Column:
    """City, state and country of an address-component array, as a struct.

    A component is read as a locality first, then as a state, then as a country; the last match of
    each kind wins. Countries other than the supported ones are null.
    """

    def has(part: Column, kind: str) -> Column:
        return F.coalesce(F.array_contains(part["types"], kind), F.lit(False))

    def is_state(part: Column) -> Column:
        return ~has(part, "locality") & has(part, "administrative_area_level_1")

    def is_country(part: Column) -> Column:
        earlier = has(part, "locality") | has(part, "administrative_area_level_1")
        return ~earlier & has(part, "country") & part["short_name"].isin(fv.COUNTRIES)

    def last(test) -> Column:
        return F.try_element_at(F.filter(components, test), F.lit(-1))

    return F.struct(
        last(lambda p: has(p, "locality"))["long_name"].alias("city"),
        last(is_state)["short_name"].alias("state_province"),
        last(is_country)["short_name"].alias("country"),
    )


def operational_places(places: DataFrame) -> DataFrame:
    """The first record of each place in a run, if that one is open for business."""
    status = F.col("business_status")
    first = C.first_per_key(places, ["run_id", "place_id"], [F.col("seq")])
    return first.filter(status.isNull() | (status == "OPERATIONAL"))


NAME_KEY = ["_name", "_city", "_state"]


def _keyed(df: DataFrame, name: str) -> DataFrame:
    """Add the normalised duplicate key. Nulls are a value of their own, so plain equality works."""

    def part(value: Column) -> Column:
        return F.struct(value.isNull().alias("none"), F.coalesce(value, F.lit("")).alias("value"))

    return (
        df.withColumn("_name", C.norm(F.col(name)))
        .withColumn("_city", part(F.col("city")))
        .withColumn("_state", part(F.col("state_province")))
    )


def new_places(found: DataFrame, known_leads: DataFrame, source: str = "google_maps") -> DataFrame:
    """Those of the operational places that become leads, in five steps.

    Known source id, other country, known name and location, repeated place of an earlier run,
    repeated name and location inside the batch: each drops a record. The two in-batch steps keep
    the first arrival, with a per-task group limit ahead of each shuffle.
    """
    known_ids = (
        known_leads.filter(F.col("source") == source)
        .select(F.col("source_id").alias("place_id"))
        .filter(F.col("place_id").isNotNull())
        .distinct()
    )
    known_names = _keyed(known_leads, "business_name").select(*NAME_KEY).distinct()
    fresh = (
        _keyed(found.filter(F.col("country").isin(fv.COUNTRIES)), "name")
        .join(known_ids, "place_id", "left_anti")
        .join(known_names, NAME_KEY, "left_anti")
    )
    once = C.first_per_key(fresh, ["place_id"], [F.col("seq")])
    return C.first_per_key(once, NAME_KEY, [F.col("seq")]).drop(*NAME_KEY)


def run_counters(
    found: DataFrame, known_leads: DataFrame, new: DataFrame, source: str = "google_maps",
    by: str = "run_id",
) -> DataFrame:
    """Found, new and duplicate records per run.

    A record is a duplicate when its source id is known, or when it lies in a supported country
    and did not become a lead. Only two aggregates are shuffled, not the records.
    """
    known_ids = (
        known_leads.filter(F.col("source") == source)
        .select(F.col("source_id").alias("place_id"), F.lit(True).alias("_known"))
        .distinct()
    )
    supported = F.coalesce(F.col("country").isin(fv.COUNTRIES), F.lit(False))
    eligible = F.col("_known").isNotNull() | supported
    seen = (
        found.select(by, "place_id", "country")
        .join(known_ids, "place_id", "left")
        .groupBy(by)
        .agg(F.count("*").alias("leads_found"), C.count_where(eligible).alias("_eligible"))
    )
    made = new.groupBy(by).agg(F.count("*").alias("_new"))
    made_or_none = F.coalesce("_new", F.lit(0))
    return seen.join(made, by, "left").select(
        by,
        "leads_found",
        made_or_none.alias("leads_new"),
        (F.col("_eligible") - made_or_none).alias("leads_duplicate"),
    )


def metro_totals(counters: DataFrame, metros: Sequence[str] = ("metro",)) -> DataFrame:
    """Totals per metro and the grand total, which has a null metro."""
    return counters.rollup(*metros).agg(
        *[F.sum(c).alias(c) for c in ("leads_found", "leads_new", "leads_duplicate")]
    )


def to_leads(new: DataFrame, as_of: datetime | str, source: str = "google_maps") -> DataFrame:
    """New places as rows of the lead table, with defaults. Contact details are kept if given."""

    def optional(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in new.columns else F.lit(None)).cast(kind)

    types = F.col("types") if "types" in new.columns else None
    now = C.moment(as_of)
    return new.select(
        F.xxhash64(F.lit(source), F.col("place_id")).cast("string").alias("id"),
        F.col("name").alias("business_name"),
        X.business_type(F.col("name"), types).alias("business_type"),
        optional("website").alias("website"),
        optional("phone").alias("phone"),
        optional("address").alias("address"),
        "city",
        "state_province",
        "country",
        F.lit(source).alias("source"),
        F.col("place_id").alias("source_id"),
        optional("google_rating", "double").alias("google_rating"),
        optional("google_review_count", "int").alias("google_review_count"),
        F.lit(0).alias("score"),
        F.lit("new").alias("pipeline_stage"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def manual_leads(requests: DataFrame, as_of: datetime | str) -> DataFrame:
    """Leads entered by hand: empty texts become null, a name is required."""
    blank = F.lit("")

    def given(name: str) -> Column:
        value = F.col(name) if name in requests.columns else F.lit(None).cast("string")
        return F.nullif(value, blank).alias(name)

    now = C.moment(as_of)
    key = ["business_name", "city", "state_province"]
    named = requests.filter(F.length("business_name") > 0).select(
        "business_name",
        *[given(c) for c in ("business_type", "website", "phone", "city", "state_province", "country")],
    )
    return named.select(
        F.xxhash64(F.lit("manual"), *key).cast("string").alias("id"),
        *named.columns,
        F.lit(None).cast("string").alias("address"),
        F.lit("manual").alias("source"),
        F.lit(None).cast("string").alias("source_id"),
        F.lit(None).cast("double").alias("google_rating"),
        F.lit(None).cast("int").alias("google_review_count"),
        F.lit(0).alias("score"),
        F.lit("new").alias("pipeline_stage"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


# -- run log ------------------------------------------------------------------------------------
def start_runs(requests: DataFrame, as_of: datetime | str) -> DataFrame:
    """Run-log rows in status ``running`` for ``(id, source, query, location)``."""
    return requests.select(
        "id", "source", "query", "location",
        *[F.lit(0).cast("long").alias(c) for c in ("leads_found", "leads_new", "leads_duplicate")],
        F.lit("running").alias("status"),
        C.moment(as_of).alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(None).cast("string").alias("error_message"),
    )


def finish_runs(runs: DataFrame, results: DataFrame, as_of: datetime | str) -> DataFrame:
    """Close runs from ``(id, leads_found, leads_new, leads_duplicate, error_message)`` rows.

    A run with an error fails and keeps its counters; the others complete.
    """
    counters = ["leads_found", "leads_new", "leads_duplicate"]
    new = results.select(
        "id", F.lit(True).alias("_done"), F.col("error_message").alias("_error"),
        *[F.col(c).alias("_" + c) for c in counters],
    )
    done, failed = F.coalesce("_done", F.lit(False)), F.col("_error").isNotNull()
    out = runs.join(new, "id", "left")
    for c in counters:
        out = out.withColumn(c, F.when(done & ~failed, F.col("_" + c)).otherwise(F.col(c)))
    status = F.when(done & failed, "failed").when(done, "completed").otherwise(F.col("status"))
    return (
        out.withColumn("status", status)
        .withColumn("completed_at", F.when(done, C.moment(as_of)).otherwise(F.col("completed_at")))
        .withColumn("error_message", F.coalesce("_error", "error_message"))
        .select(*runs.columns)
    )


def recent_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    return C.top(runs, [F.desc("started_at"), F.col("id")], limit)


# -- further duplicates ---------------------------------------------------------------------------
def drop_same_contact(
    leads: DataFrame, order: Sequence[Column] | None = None, suffixes: DataFrame | None = None
) -> DataFrame:
    """One lead per phone number and one per root domain; leads without either are all kept.

    The phone is compared by its digits, the website by its root domain, which knows the common public suffixes
    and hosting platforms, or follows the rules ``suffixes`` (see `suffixes.suffix_rules`) where these are given.
    """
    order = list(order or [F.col("id")])
    phone = F.nullif(F.regexp_replace("phone", r"\D", ""), F.lit(""))
    domain = X.root_domain(X.host_of(X.base_url(F.col("website"))))
    keyed = leads.withColumn("_phone", phone)
    by_phone = C.first_per_key(keyed.filter("_phone IS NOT NULL"), ["_phone"], order)
    rest = by_phone.unionByName(keyed.filter("_phone IS NULL"))
    if suffixes is None:
        rest = rest.withColumn("_domain", domain)
    else:
        hosts = rest.select(X.host_of(X.base_url(F.col("website"))).alias("_host")).distinct()
        known = with_registered_domain(hosts, suffixes, "_host").select("_host", F.col("domain").alias("_domain"))
        rest = rest.withColumn("_host", X.host_of(X.base_url(F.col("website")))).join(known, "_host", "left").drop("_host")
    by_domain = C.first_per_key(rest.filter("_domain IS NOT NULL"), ["_domain"], order)
    return by_domain.unionByName(rest.filter("_domain IS NULL")).drop("_phone", "_domain")
