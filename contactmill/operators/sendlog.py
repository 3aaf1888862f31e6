"""Send log: statistics, circuit breaker, daily budget and the single outreach mail."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import columns as C
from contactmill.functions import fixed_values as fv
from contactmill.operators import leads as L
from contactmill.operators.snapshots import latest, patch


def _since(as_of: datetime | str, days: int) -> Column:
    return C.moment(as_of) - F.make_dt_interval(F.lit(days))


def send_stats(send_log: DataFrame, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Sends per status over the trailing days, with bounce and complaint rates in percent."""
    recent = send_log.filter(F.col("sent_at") >= _since(as_of, days))
    return with_rates(recent.agg(*status_counts()))


def status_counts() -> list[Column]:
    return [
        F.count("*").alias("total"),
        *[C.count_where(F.col("status") == s).alias(s) for s in fv.SEND_STATUSES],
    ]


def with_rates(counted: DataFrame) -> DataFrame:
    """Bounce and complaint rate over all rows, opened and clicked ones included."""
    return counted.withColumn("bounce_rate", C.share(F.col("bounced"), F.col("total"))).withColumn(
        "complaint_rate", C.share(F.col("complained"), F.col("total"))
    )


def with_breaker(
    rated: DataFrame,
    max_bounce: float = fv.BREAKER_BOUNCE_PERCENT,
    max_complaint: float = fv.BREAKER_COMPLAINT_PERCENT,
    min_sends: int = fv.BREAKER_MIN_SENDS,
) -> DataFrame:
    """Add ``pause`` and ``reason`` from the rounded rates."""
    judged = F.col("sent") + F.col("delivered") + F.col("bounced") + F.col("complained")

    def text(name: str, rate: str, limit: float) -> Column:
        return F.concat(
            F.lit(f"{name} rate "), plain_number(F.col(rate)), F.lit(f"% exceeds {limit:g}% threshold")
        )

    reason = F.when(
        judged >= min_sends,
        F.when(F.col("bounce_rate") > max_bounce, text("Bounce", "bounce_rate", max_bounce)).when(
            F.col("complaint_rate") > max_complaint,
            text("Complaint", "complaint_rate", max_complaint),
        ),
    )
    return rated.withColumn("reason", reason).withColumn("pause", F.col("reason").isNotNull())


def plain_number(value: Column) -> Column:
    """A number with at most one decimal as text, without a closing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0\z", "")


def breaker(send_log: DataFrame, as_of: datetime | str) -> DataFrame:
    """Whether sending should pause, from the trailing 24 hours."""
    return with_breaker(send_stats(send_log, as_of, days=1)).select(
        "pause", "reason", "bounce_rate", "complaint_rate"
    )


def today_from(as_of: datetime | str) -> Column:
    return F.date_trunc("day", C.moment(as_of))


def sent_today(send_log: DataFrame, as_of: datetime | str) -> DataFrame:
    """Sends of the UTC day in status ``sent``, and ``attempted`` whatever became of them."""
    today = send_log.filter(F.col("sent_at") >= today_from(as_of))
    return today.agg(
        C.count_where(F.col("status") == "sent").alias("sent_today"), F.count("*").alias("attempted")
    )


def sent_per_day(send_log: DataFrame) -> DataFrame:
    """Daily history of the budget count, for every day with sends."""
    return send_log.groupBy(F.date_trunc("day", "sent_at").alias("day")).agg(
        C.count_where(F.col("status") == "sent").alias("sent"), F.count("*").alias("attempted")
    )


def history_of_lead(send_log: DataFrame, lead_id: object) -> DataFrame:
    return L.by_id(send_log, lead_id, "lead_id").orderBy(F.desc("sent_at"), F.col("id"))


def append_sends(send_log: DataFrame, sends: DataFrame) -> DataFrame:
    return send_log.unionByName(sends, allowMissingColumns=True)


def apply_delivery_events(send_log: DataFrame, events: DataFrame) -> DataFrame:
    """Set the status from ``(ses_message_id, status, at)`` events, the last one per message.

    A message id that several log rows carry updates all of them. Rows that never got an id, which
    may be many, stay out of the join.
    """
    last = latest(events.filter("ses_message_id IS NOT NULL"), "ses_message_id", "status", "at")
    known = F.col("ses_message_id").isNotNull()
    updated = patch(send_log.filter(known), last, "ses_message_id", ["status"])
    return updated.unionByName(send_log.filter(~known))


def set_send_status(send_log: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the status by log id."""
    return patch(send_log, changes, "id", ["status"])


def latest_send_status(send_log: DataFrame) -> DataFrame:
    """Last known status per provider message."""
    known = send_log.filter("ses_message_id IS NOT NULL")
    return latest(known.withColumnRenamed("sent_at", "at"), "ses_message_id", "status", "at")


# -- single outreach ---------------------------------------------------------------------------
def outreach_stats(send_log: DataFrame, as_of: datetime | str) -> DataFrame:
    single = send_log.filter("sequence_id IS NULL")
    return single.agg(
        F.count("*").alias("total"),
        C.count_where(F.col("sent_at") >= today_from(as_of)).alias("today"),
    )


def _eligible(
    leads: DataFrame, lead_emails: DataFrame, send_log: DataFrame, enrollments: DataFrame
) -> DataFrame:
    """Leads with a deliverable e-mail, no single send, no active or unsubscribed enrolment.

    One row per lead with its best e-mail; each side is reduced to one row per lead before the
    joins, which then share the partitioning by lead.
    """
    mail = L.best_email(lead_emails).select(
        F.col("lead_id").alias("id"), F.col("id").alias("email_id"), "email"
    )
    written = (
        send_log.filter("sequence_id IS NULL").select(F.col("lead_id").alias("id")).distinct()
    )
    busy = (
        enrollments.filter(F.col("status").isin("active", "unsubscribed"))
        .select(F.col("lead_id").alias("id"))
        .distinct()
    )
    return leads.join(mail, "id").join(written, "id", "left_anti").join(busy, "id", "left_anti")


def outreach_eligible(
    leads: DataFrame, lead_emails: DataFrame, send_log: DataFrame, enrollments: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    rows = _eligible(leads, lead_emails, send_log, enrollments)
    return C.top(rows, [F.desc("score"), F.col("id")], limit)


def outreach_eligible_count(
    leads: DataFrame, lead_emails: DataFrame, send_log: DataFrame, enrollments: DataFrame
) -> DataFrame:
    rows = _eligible(leads, lead_emails, send_log, enrollments)
    return rows.agg(F.count("*").alias("eligible"))


def has_received_outreach(leads: DataFrame, send_log: DataFrame) -> DataFrame:
    return L.outreach_sent(leads, send_log)


def render_outreach(leads: DataFrame, subject: str, body: str) -> DataFrame:
    """Put the business name into a fixed subject (first place) and body (all places)."""
    mark, name = "{{business_name}}", F.coalesce("business_name", F.lit(""))
    head, found, rest = subject.partition(mark)
    line = F.concat(F.lit(head), name, F.lit(rest)) if found else F.lit(subject)
    return leads.withColumn("subject", line).withColumn(
        "body", F.replace(F.lit(body), F.lit(mark), name)
    )


# -- funnel -----------------------------------------------------------------------------------
def funnel(
    leads: DataFrame, lead_emails: DataFrame, send_log: DataFrame, replies: DataFrame | None = None
) -> DataFrame:
    """Find, delivery, open, reply, bounce and complaint rates in percent, with their targets."""
    reached = ["delivered", "opened", "clicked", "complained"]
    sends = send_log.agg(
        F.count("*").alias("sends"),
        C.count_where(F.col("status").isin(reached)).alias("reached"),
        C.count_where(F.col("status").isin("opened", "clicked")).alias("opened"),
        C.count_where(F.col("status") == "bounced").alias("bounced"),
        C.count_where(F.col("status") == "complained").alias("complained"),
    )
    found = L.with_emails(leads, lead_emails).agg(F.count("*").alias("with_email"))
    total = leads.agg(F.count("*").alias("leads"))
    row = C.beside(sends, found, total)
    if replies is None:
        row = row.withColumn("replied", F.lit(0).cast("long"))
    else:
        answered = replies.select("ses_message_id").distinct()
        mails = send_log.select("ses_message_id").distinct()
        matched = mails.join(answered, "ses_message_id", "left_semi")
        row = C.beside(row, matched.agg(F.count("*").alias("replied")))
    shares = {
        "email_find_rate": ("with_email", "leads"),
        "delivery_rate": ("reached", "sends"),
        "open_rate": ("opened", "sends"),
        "reply_rate": ("replied", "sends"),
        "bounce_rate": ("bounced", "sends"),
        "complaint_rate": ("complained", "sends"),
    }
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            C.share(F.col(part), F.col(whole)).alias("value"),
            F.lit(fv.FUNNEL_TARGETS[name]).alias("target"),
        )
        for name, (part, whole) in shares.items()
    ]
    at_most = F.col("metric").isin("bounce_rate", "complaint_rate")
    met = F.when(at_most, F.col("value") < F.col("target")).otherwise(F.col("value") > F.col("target"))
    return row.select(F.inline(F.array(*entries))).withColumn("target_met", met)
