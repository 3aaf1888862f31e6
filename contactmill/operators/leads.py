"""Lead and e-mail queries: look-ups, filters, queues, statistics and pages of a listing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import columns as C
from contactmill.functions import fixed_values as fv
from contactmill.operators.running import numbered
from contactmill.operators.search import matches


def _by_score() -> list[Column]:
    return [F.desc("score"), F.col("id")]


# -- look-ups -------------------------------------------------------------------------------
def by_id(table: DataFrame, value: object, key: str = "id") -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def by_source(leads: DataFrame, source: str, source_id: str) -> DataFrame:
    return leads.filter((F.col("source") == source) & (F.col("source_id") == source_id))


def emails_of_lead(lead_emails: DataFrame, lead_id: object) -> DataFrame:
    return by_id(lead_emails, lead_id, "lead_id").orderBy(F.desc("is_primary"), "id")


def email_exists(lead_emails: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``(lead_id, email)`` rows of ``wanted`` that the lead already has, in any case."""
    known = lead_emails.select("lead_id", F.lower("email").alias("_email")).distinct()
    asked = wanted.withColumn("_email", F.lower("email"))
    return asked.join(known, ["lead_id", "_email"], "left_semi").select(*wanted.columns)


# -- lists ------------------------------------------------------------------------------------
def of_stage(leads: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    return C.top(leads.filter(F.col("pipeline_stage") == stage), _by_score(), limit)


def top_scored(leads: DataFrame, limit: int | None = None) -> DataFrame:
    return C.top(leads.filter(F.col("score") > 0), _by_score(), limit)


def newest(leads: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return C.top(leads, [F.desc("created_at"), F.col("id")], limit, offset)


def count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def _lead_keys(lead_emails: DataFrame, condition: Column | None = None) -> DataFrame:
    """Distinct lead ids, so a lead with very many e-mails crosses the network once per task."""
    rows = lead_emails if condition is None else lead_emails.filter(condition)
    return rows.select(F.col("lead_id").alias("id")).distinct()


def with_email_status(leads: DataFrame, lead_emails: DataFrame, status: str) -> DataFrame:
    keys = _lead_keys(lead_emails, F.col("verification_status") == status)
    return leads.join(keys, "id", "left_semi")


def with_valid_email(leads: DataFrame, lead_emails: DataFrame) -> DataFrame:
    return with_email_status(leads, lead_emails, "valid")


def with_emails(leads: DataFrame, lead_emails: DataFrame) -> DataFrame:
    return leads.join(_lead_keys(lead_emails), "id", "left_semi")


def without_emails(leads: DataFrame, lead_emails: DataFrame) -> DataFrame:
    """Every lead without an e-mail; see :func:`reenrich_queue` for those worth a new attempt."""
    return leads.join(_lead_keys(lead_emails), "id", "left_anti")


def not_enriched(leads: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Leads with a website that were never enriched."""
    done = enrichment.select(F.col("lead_id").alias("id"))
    return leads.filter(F.col("website").isNotNull()).join(done, "id", "left_anti")


def reenrich_queue(
    leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame, as_of: datetime | str
) -> DataFrame:
    """Leads with a website and no e-mail that were never tried, or tried in vain long ago."""
    columns = ["emails_found_count", "enrichment_attempts", "last_enrichment_attempt_at"]
    tried = enrichment.select(F.col("lead_id").alias("id"), F.lit(True).alias("_tried"), *columns)
    wanted = tried.withColumn("_again", F.coalesce(tried_in_vain(as_of), F.lit(False))).drop(*columns)
    return (
        without_emails(leads.filter(F.col("website").isNotNull()), lead_emails)
        .join(wanted, "id", "left")
        .filter(F.col("_tried").isNull() | F.col("_again"))
        .drop("_tried", "_again")
    )


# -- one e-mail per lead --------------------------------------------------------------------------
def primary_email(lead_emails: DataFrame) -> DataFrame:
    return C.first_per_key(lead_emails.filter("is_primary"), ["lead_id"], [F.col("id")])


def first_email(lead_emails: DataFrame) -> DataFrame:
    """The primary e-mail of a lead, or any other it has."""
    return C.first_per_key(lead_emails, ["lead_id"], [F.desc("is_primary"), F.col("id")])


def best_email(lead_emails: DataFrame) -> DataFrame:
    """The e-mail to write to: valid before catch-all, then the primary one."""
    status = F.col("verification_status")
    rank = F.when(status == "valid", 1).when(status == "catch_all", 2)
    return C.first_per_key(
        lead_emails.filter(status.isin("valid", "catch_all")),
        ["lead_id"],
        [rank, F.desc("is_primary"), F.col("id")],
    )


# -- statistics --------------------------------------------------------------------------------
def counts_by(table: DataFrame, column: str, known: list[str] | None = None) -> DataFrame:
    """Rows per value; with ``known`` exactly those values are listed, absent ones with 0."""
    counted = table.groupBy(column).agg(F.count("*").alias("n"))
    if known is None:
        return counted
    listed = table.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return listed.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def status_counts_wide(table: DataFrame, column: str, known: list[str]) -> DataFrame:
    """One row with a count column per known value, in a single pass."""
    return table.agg(*[C.count_where(F.col(column) == k).alias(k) for k in known])


def email_status_counts(lead_emails: DataFrame) -> DataFrame:
    return counts_by(lead_emails, "verification_status", fv.VERIFICATION_STATUSES)


def stage_counts(leads: DataFrame) -> DataFrame:
    return counts_by(leads, "pipeline_stage")


def source_counts(leads: DataFrame) -> DataFrame:
    return counts_by(leads, "source")


def lead_stats(leads: DataFrame, lead_emails: DataFrame) -> DataFrame:
    """Totals, average score and the counts per stage and source as maps, in one row.

    Each table is read once: leads are counted per stage and source, and these few groups folded.
    """
    scored = F.col("score") > 0
    groups = leads.groupBy(
        F.coalesce("pipeline_stage", F.lit("")).alias("by_stage"), F.coalesce("source", F.lit("")).alias("by_source")
    ).agg(F.count("*").alias("n"), F.sum(F.when(scored, F.col("score"))).alias("points"), C.count_where(scored).alias("scored"))
    folded = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_leads"), F.sum("points").alias("points"), F.sum("scored").alias("scored"),
        F.collect_list(F.struct("by_stage", "by_source", "n")).alias("groups"),
    )

    def as_map(key: str) -> Column:
        def of(name: Column) -> Column:
            own = F.filter("groups", lambda g: g[key] == name)
            return F.struct(name, F.aggregate(own, F.lit(0).cast("long"), lambda total, g: total + g["n"]))

        return F.map_from_entries(F.transform(F.array_distinct(F.col("groups")[key]), of)).alias(key)

    average = C.half_up(F.when(F.col("scored") > 0, F.col("points") / F.col("scored")), 1)
    totals = folded.select(
        "total_leads", F.coalesce(average, F.lit(0.0)).alias("avg_score"), as_map("by_stage"), as_map("by_source")
    )
    per_lead = lead_emails.groupBy("lead_id").agg(
        C.count_where(F.col("verification_status") == "valid").alias("_valid")
    )
    mails = per_lead.agg(
        F.count("*").alias("leads_with_emails"),
        F.coalesce(F.sum("_valid"), F.lit(0)).alias("verified_emails"),
    )
    return C.beside(totals, mails).select(
        "total_leads", "avg_score", "leads_with_emails", "verified_emails", "by_stage", "by_source"
    )


def extended_stats(
    leads: DataFrame,
    lead_emails: DataFrame,
    enrichment: DataFrame,
    send_log: DataFrame,
    as_of: datetime | str,
) -> DataFrame:
    """The statistics row of the overview: totals, queues, verification and outreach counts.

    One pass over each table: a row of flags per lead, see :func:`lead_flags`, then one aggregation.
    """
    rows = lead_flags(leads, lead_emails, enrichment, send_log, as_of)
    scores = F.avg(F.when(F.col("score") > 0, F.col("score")))
    total, mailed = F.count("id"), C.count_where(F.col("id").isNotNull() & (F.col("n_emails") > 0))
    rate = C.half_up(mailed * 100 / F.nullif(total, F.lit(0)))
    return rows.agg(
        total.alias("total_leads"),
        F.coalesce(C.half_up(scores, 1), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.sum("n_valid"), F.lit(0)).alias("verified_emails"),
        mailed.alias("leads_with_emails"),
        C.count_where(F.col("queued")).alias("leads_without_emails"),
        C.count_where(F.col("never_enriched")).alias("not_enriched"),
        *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(s) for s in fv.VERIFICATION_STATUSES],
        F.coalesce(F.sum("n_single"), F.lit(0)).alias("outreach_total"),
        F.coalesce(F.sum("n_single_today"), F.lit(0)).alias("outreach_today"),
        F.coalesce(rate, F.lit(0)).cast("long").alias("email_success_rate"),
    )


def lead_flags(
    leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame, send_log: DataFrame, as_of: datetime | str
) -> DataFrame:
    """A row per lead with what statistics and filters ask of it: ``id``, ``score``, counts and flags.

    E-mails and sends are counted per lead before they meet the leads, so a lead with very many of them
    crosses the network once per task; each table is read once. Rows whose lead is unknown or null have a null
    ``id``: they only count in the totals of e-mails and sends.
    """
    from contactmill.operators.sendlog import today_from

    status = F.col("verification_status")
    mails = lead_emails.groupBy(F.col("lead_id").alias("_lead")).agg(
        F.count("*").alias("n_emails"), *[C.count_where(status == s).alias(f"n_{s}") for s in fv.VERIFICATION_STATUSES]
    )
    single = F.col("sequence_id").isNull()
    sends = send_log.groupBy(F.col("lead_id").alias("_lead")).agg(
        C.count_where(single).alias("n_single"), C.count_where(single & (F.col("sent_at") >= today_from(as_of))).alias("n_single_today")
    )
    tried = enrichment.select(
        F.col("lead_id").alias("_lead"), F.lit(True).alias("_tried"), "emails_found_count", "enrichment_attempts",
        "last_enrichment_attempt_at",
    )
    known = leads.select("id", F.col("id").alias("_lead"), "score", F.col("website").isNotNull().alias("_site"))
    rows = known.join(mails, "_lead", "full_outer").join(sends, "_lead", "full_outer").join(tried, "_lead", "left")
    counts = ["n_emails", *[f"n_{s}" for s in fv.VERIFICATION_STATUSES], "n_single", "n_single_today"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    never = F.col("_tried").isNull()
    site = F.coalesce("_site", F.lit(False))
    again = F.coalesce(tried_in_vain(as_of), F.lit(False))
    return rows.select(
        "id", "score", *counts,
        (site & (F.col("n_emails") == 0) & (never | again)).alias("queued"),
        (site & never).alias("never_enriched"),
    )


def tried_in_vain(as_of: datetime | str) -> Column:
    """Enrichment that found nothing, may be repeated and is long enough ago."""
    before = C.moment(as_of) - F.make_dt_interval(F.lit(fv.REENRICH_AFTER_DAYS))
    return (
        (F.col("emails_found_count") == 0)
        & (F.col("enrichment_attempts") < fv.REENRICH_MAX_ATTEMPTS)
        & (F.col("last_enrichment_attempt_at") < before)
    )


def listing_counts(
    leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame, send_log: DataFrame, as_of: datetime | str
) -> DataFrame:
    """Size and id sum of every named lead filter, in one aggregation over :func:`lead_flags`."""
    rows = lead_flags(leads, lead_emails, enrichment, send_log, as_of).filter("id IS NOT NULL")
    mail_statuses = {n: F.col(f"n_{s}") > 0 for n, s in _STATUS_FILTERS.items()}
    bands = {n: _score_band(*band) for n, band in _SCORE_BANDS.items()}
    sent = F.col("n_single") > 0
    tests = mail_statuses | bands | {
        "all": F.lit(True),
        "with-emails": F.col("n_emails") > 0,
        "without-emails": F.col("queued"),
        "outreach-sent": sent,
        "outreach-pending": ((F.col("n_valid") > 0) | (F.col("n_catch_all") > 0)) & ~sent,
    }
    one = rows.agg(
        *[C.count_where(tests[n]).alias(f"n{i}") for i, n in enumerate(LISTING_FILTERS)],
        *[F.sum(F.when(tests[n], F.col("id"))).alias(f"s{i}") for i, n in enumerate(LISTING_FILTERS)],
    )
    entries = [
        F.struct(F.lit(n).alias("filter"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("id_sum"))
        for i, n in enumerate(LISTING_FILTERS)
    ]
    return one.select(F.inline(F.array(*entries)))


# -- filtered listing --------------------------------------------------------------------------
def _score_band(low: int | None, high: int | None) -> Column:
    out = F.col("score") > 0
    if low is not None:
        out = out & (F.col("score") >= low)
    return out if high is None else out & (F.col("score") < high)


def outreach_sent(leads: DataFrame, send_log: DataFrame) -> DataFrame:
    """Leads that got the single outreach mail: a send outside any sequence."""
    return leads.join(_single_sends(send_log), "id", "left_semi")


def _single_sends(send_log: DataFrame) -> DataFrame:
    return send_log.filter("sequence_id IS NULL").select(F.col("lead_id").alias("id")).distinct()


def outreach_pending(leads: DataFrame, lead_emails: DataFrame, send_log: DataFrame) -> DataFrame:
    """Leads with a valid or catch-all e-mail and no outreach so far, each once."""
    keys = _lead_keys(lead_emails, F.col("verification_status").isin("valid", "catch_all"))
    return leads.join(keys, "id", "left_semi").join(_single_sends(send_log), "id", "left_anti")


LISTING_FILTERS = [
    "all", "with-emails", "without-emails", "hot", "warm", "cold", "valid", "invalid", "catch-all",
    "unknown", "unverified", "outreach-sent", "outreach-pending", "scored", "verified",
    "warm-or-better",
]
_STATUS_FILTERS = {
    "valid": "valid", "verified": "valid", "invalid": "invalid", "catch-all": "catch_all", "unknown": "unknown",
    "unverified": "unverified",
}
_SCORE_BANDS = {
    "hot": (70, None), "warm": (50, 70), "cold": (None, 50), "scored": (None, None), "warm-or-better": (50, None),
}


def filtered(
    name: str,
    leads: DataFrame,
    lead_emails: DataFrame,
    enrichment: DataFrame,
    send_log: DataFrame,
    as_of: datetime | str,
) -> DataFrame:
    """One of the named lead filters, unordered.

    ``warm`` is the band below hot; ``warm-or-better`` includes hot, as the exports have it.
    """
    if name in _STATUS_FILTERS:
        return with_email_status(leads, lead_emails, _STATUS_FILTERS[name])
    if name in _SCORE_BANDS:
        return leads.filter(_score_band(*_SCORE_BANDS[name]))
    if name == "with-emails":
        return with_emails(leads, lead_emails)
    if name == "without-emails":
        return reenrich_queue(leads, lead_emails, enrichment, as_of)
    if name == "outreach-sent":
        return outreach_sent(leads, send_log)
    if name == "outreach-pending":
        return outreach_pending(leads, lead_emails, send_log)
    if name == "all":
        return leads
    raise ValueError(f"unknown lead filter: {name}")


def search(leads: DataFrame, term: str) -> DataFrame:
    """Leads with the term in name, city or website, in any case. The term has no wildcards.

    Reads all leads; ``operators.search.LeadIndex`` gives the same rows from an index.
    """
    return leads.filter(matches(term))


def page(leads: DataFrame, page_no: int = 1, limit: int = 50) -> DataFrame:
    """One page of a listing by score; the sort keeps only the rows up to the end of the page.

    For pages far down make the starts of all pages once (:func:`page_starts`) and use :func:`page_from`.
    """
    return C.top(leads, _by_score(), limit, (page_no - 1) * limit)


def page_starts(leads: DataFrame, limit: int = 50) -> DataFrame:
    """``(page, score, id)`` of the first row of every page of a listing by score. Ids are unique.

    The rows are numbered over ranges of the order, so no task holds more than its range.
    """
    rows = numbered(leads.select("score", "id"), _by_score(), "_number")
    first = rows.filter((F.col("_number") - 1) % limit == 0)
    return first.select((F.floor((F.col("_number") - 1) / limit) + 1).alias("page"), "score", "id")


def page_from(leads: DataFrame, starts: DataFrame, page_no: int, limit: int = 50) -> DataFrame:
    """The page that :func:`page` gives, found by the start of the page: a top-k of ``limit`` rows at any depth.

    ``starts`` are those of the same leads and limit. A page beyond the last one is empty.
    """
    start = starts.filter(F.col("page") == page_no).select(F.struct("score", "id").alias("s"))
    rows = leads.withColumn("_start", start.scalar())
    score, first = F.col("_start.score"), F.col("_start.id")
    tied = F.col("score").eqNullSafe(score) & (F.col("id") >= first)
    later = F.coalesce(F.col("score") < score, F.col("score").isNull() & score.isNotNull())
    inside = F.col("_start").isNotNull() & (tied | later)
    return C.top(rows.filter(inside).drop("_start"), _by_score(), limit)


def pagination(leads: DataFrame, page_no: int = 1, limit: int = 50) -> DataFrame:
    return leads.agg(F.count("*").alias("total")).select(
        F.lit(page_no).alias("page"),
        F.lit(limit).alias("limit"),
        "total",
        F.ceil(F.col("total") / limit).alias("total_pages"),
    )


EMAILS_PER_ROW = 1000
_EMAIL_FIELDS = ["id", "email", "role", "verification_status", "is_primary"]


def _large_leads(lead_emails: DataFrame, per_row: int) -> DataFrame:
    """Leads with more e-mails than one row should hold, and the rows they are spread over."""
    return (
        lead_emails.groupBy("lead_id")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > per_row)
        .select("lead_id", F.ceil(F.col("_n") * 2 / per_row).cast("int").alias("_parts"))
    )


def email_lists(lead_emails: DataFrame, per_row: int = EMAILS_PER_ROW) -> DataFrame:
    """E-mails as arrays, primary first: ``(lead_id, part, emails)``.

    A lead with up to ``per_row`` e-mails has the one row ``part = 0``. The e-mails of a larger
    lead are spread over as many rows as needed, so no group grows without bound and none is cut.
    The rows are partitioned by lead and part: by lead alone, all parts would meet in one task.
    """
    fields = [c for c in _EMAIL_FIELDS if c in lead_emails.columns]
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(0)).cast("int")
    entry = F.struct((~F.col("is_primary")).alias("_later"), *fields)
    return (
        lead_emails.join(_large_leads(lead_emails, per_row), "lead_id", "left")
        .withColumn("part", part)
        .select("lead_id", "part", entry.alias("_entry"))
        .repartition("lead_id", "part")
        .groupBy("lead_id", "part")
        .agg(F.sort_array(F.collect_list("_entry")).alias("_emails"))
        .select(
            "lead_id",
            "part",
            F.transform(
                "_emails", lambda e: F.struct(*[e[f].alias(f) for f in fields])
            ).alias("emails"),
        )
    )


def with_details(
    leads_page: DataFrame,
    lead_emails: DataFrame,
    enrichment: DataFrame,
    fields: tuple[str, ...] = ("has_multiple_tutors", "existing_scheduling_tool", "enrichment_attempts"),
    send_log: DataFrame | None = None,
    per_row: int = EMAILS_PER_ROW,
    few: bool = True,
) -> DataFrame:
    """Attach the e-mail array and an enrichment struct to leads, one row per lead and part.

    ``few`` says that the leads are a small part of all: e-mails are then cut down to them before
    they are gathered. ``send_log`` adds ``outreach_sent``, as the view of a single lead has it.
    Leads meet their e-mails by lead and part, so a large lead is joined in several tasks too.
    """
    keys = leads_page.select(F.col("id").alias("lead_id"))
    own = lead_emails.join(keys, "lead_id", "left_semi") if few else lead_emails
    lists = email_lists(own, per_row).withColumnRenamed("lead_id", "id")
    large = _large_leads(own, per_row).withColumnRenamed("lead_id", "id")
    features = enrichment.select(
        F.col("lead_id").alias("id"),
        F.struct(*[f for f in fields if f in enrichment.columns]).alias("enrichment"),
    )
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    out = (
        leads_page.join(features, "id", "left")
        .join(large, "id", "left")
        .withColumn("part", F.explode(parts))
        .join(lists, ["id", "part"], "left")
        .filter(F.col("_parts").isNull() | F.col("emails").isNotNull())
        .withColumn("emails", F.coalesce("emails", F.array().cast(lists.schema["emails"].dataType)))
        .drop("_parts")
    )
    if send_log is None:
        return out
    sent = _single_sends(send_log).withColumn("_sent", F.lit(True))
    return (
        out.join(sent, "id", "left")
        .withColumn("outreach_sent", F.coalesce("_sent", F.lit(False)))
        .drop("_sent")
    )


# -- manual e-mail edits -------------------------------------------------------------------------
def add_emails(
    lead_emails: DataFrame, leads: DataFrame, wanted: DataFrame, as_of: datetime | str
) -> DataFrame:
    """Rows to append for ``(lead_id, email[, contact_name, role, verification_status])``.

    Unknown leads and empty addresses are refused. The first e-mail a lead ever gets is its
    primary one; among several added at once that is the lowest address.
    """
    have = lead_emails.select("lead_id").distinct().withColumn("_has", F.lit(True))
    known = leads.select(F.col("id").alias("lead_id"))

    def given(name: str, default: str | None) -> Column:
        value = F.col(name) if name in wanted.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(default).cast("string")).alias(name)

    rows = wanted.filter(F.length(F.col("email")) > 0).select(
        "lead_id",
        C.norm(F.col("email")).alias("email"),
        given("contact_name", None),
        given("role", "unknown"),
        given("verification_status", "unverified"),
    )
    first = rows.groupBy("lead_id").agg(F.min("email").alias("_first"))
    return (
        rows.join(known, "lead_id", "left_semi")
        .join(first, "lead_id")
        .join(have, "lead_id", "left")
        .select(
            F.xxhash64("lead_id", "email").cast("string").alias("id"),
            "lead_id", "email", "contact_name", "role", "verification_status",
            F.lit("manual").alias("source"),
            (F.col("_has").isNull() & (F.col("email") == F.col("_first"))).alias("is_primary"),
            C.moment(as_of).alias("created_at"),
        )
    )
