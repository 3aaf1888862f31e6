"""Exports of leads: a flat CSV table and nested JSON records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.operators import leads as L
from contactmill.operators.scoring import tier_column
from contactmill.operators.sendlog import plain_number

FLAT_COLUMNS = [
    "id", "business_name", "business_type", "website", "phone", "email", "email_verified", "address",
    "city", "state_province", "country", "google_rating", "google_review_count", "score", "tier",
    "pipeline_stage", "has_multiple_tutors", "scheduling_tool", "specialties", "source", "created_at",
]
JSON_ENRICHMENT = (
    "has_multiple_tutors", "existing_scheduling_tool", "linkedin_url", "facebook_url", "specialties",
)


def selected_leads(
    name: str, leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame, send_log: DataFrame,
    as_of: datetime | str, limit: int | None = None,
) -> DataFrame:
    """The leads of a named filter for an export: newest first for ``all``, else best score first.

    Without a limit nothing is sorted, as the files of a parallel export have no order.
    """
    rows = L.filtered(name, leads, lead_emails, enrichment, send_log, as_of)
    if limit is None:
        return rows
    return L.newest(rows, limit) if name == "all" else L.page(rows, 1, limit)


def flat_leads(leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One text row per lead with its primary (or any) e-mail and its enrichment."""
    mail = L.first_email(lead_emails).select(
        F.col("lead_id").alias("id"), "email", F.col("verification_status").alias("email_verified")
    )
    names = [c for c in ("has_multiple_tutors", "existing_scheduling_tool", "specialties")]
    features = enrichment.select(
        F.col("lead_id").alias("id"), *[F.col(c).alias("_" + c) for c in names if c in enrichment.columns]
    )
    rows = leads.join(mail, "id", "left").join(features, "id", "left")

    def text(column: str) -> Column:
        if column not in rows.columns:
            return F.lit("")
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    words = "_specialties"
    if words in rows.columns and rows.schema[words].dataType.typeName() == "array":
        rows = rows.withColumn(words, F.when(F.size(words) > 0, F.to_json(words)))
    values = {
        "email_verified": F.coalesce("email_verified", F.lit("none")),
        "google_rating": F.coalesce(plain_number(F.col("google_rating")), F.lit("")),
        "tier": tier_column(F.col("score")),
        "has_multiple_tutors": F.when(F.col("_has_multiple_tutors"), "yes").otherwise("no"),
        "scheduling_tool": text("_existing_scheduling_tool"),
        "specialties": text(words),
        "created_at": F.coalesce(
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")
        ),
    }
    return rows.select(*[(values[c] if c in values else text(c)).alias(c) for c in FLAT_COLUMNS])


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes only where needed, doubled inside, and nulls as empty fields.

    Written in parallel, one file per partition. An ordered export is sorted by ranges first.
    """
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written flat export, all columns as text."""
    schema = ", ".join(f"{c} string" for c in FLAT_COLUMNS)
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
    return spark.read.schema(schema).options(**options).csv(path).fillna("")


def nested_leads(
    leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame,
    per_row: int = L.EMAILS_PER_ROW,
) -> DataFrame:
    """Leads with an ``emails`` array and an ``enrichment`` struct.

    A lead with more than ``per_row`` e-mails is written as several records, told apart by
    ``part``; together they hold all of its e-mails.
    """
    rows = L.with_details(leads, lead_emails, enrichment, JSON_ENRICHMENT, per_row=per_row, few=False)
    fields = ("email", "role", "verification_status", "is_primary")
    return rows.withColumn(
        "emails",
        F.transform("emails", lambda e: F.struct(*[e[f].alias(f) for f in fields])),
    )


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)
