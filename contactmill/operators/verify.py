"""E-mail verification from recorded probe results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import columns as C
from contactmill.functions import fixed_values as fv
from contactmill.functions.emails import domain_part
from contactmill.operators.snapshots import patch

RECIPIENT_STEP = 3


def verification_queue(lead_emails: DataFrame, limit: int | None = None) -> DataFrame:
    waiting = lead_emails.filter(F.col("verification_status") == "unverified")
    return C.top(waiting, [F.asc("created_at"), F.col("id")], limit)


def primary_mx(mx_records: DataFrame) -> DataFrame:
    """The mail host of lowest priority per domain; ties go to the first name."""
    return mx_records.groupBy(F.lower("domain").alias("domain")).agg(
        F.min_by("exchange", F.struct("priority", "exchange")).alias("primary_mx")
    )


def probe_outcome(probes: DataFrame) -> DataFrame:
    """Reply codes to ``accepted`` and ``probe_error``.

    250 and 251 accept the recipient; 450 to 452 are a temporary failure; any other reply to the
    recipient is a plain rejection. Timeouts, socket errors and refusals before the recipient was
    named are errors. A missing ``step`` means the recipient was named.
    """
    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in probes.columns else F.lit(None).cast(kind)

    code = F.col("code")
    named = F.coalesce(optional("step", "int"), F.lit(RECIPIENT_STEP)) >= RECIPIENT_STEP
    timed_out = F.coalesce(optional("timed_out", "boolean"), F.lit(False))
    socket_error = optional("socket_error", "string")
    error = (
        F.when(timed_out, "Connection timeout")
        .when(socket_error.isNotNull(), socket_error)
        .when(named & code.isin(450, 451, 452), "Temporary failure")
        .when(~named & (code >= 400), F.concat(F.lit("SMTP error: "), code.cast("string")))
    )
    accepted = error.isNull() & named & F.coalesce(code.isin(250, 251), F.lit(False))
    return probes.withColumn("probe_error", error).withColumn("accepted", accepted)


DOMAIN_PARTS = 32


def _with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Add the mail host of each row's domain.

    A provider's domain may hold a third of all rows. Rows meet their hosts by domain and a part of their
    ids, so that domain is spread over tasks; the hosts are looked up once per domain and part.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(DOMAIN_PARTS))
    parted = rows.withColumn("_part", part)
    found = parted.select("_domain", "_part").distinct().join(hosts, "_domain")
    return parted.join(found, ["_domain", "_part"], "left").drop("_part")


def verify(
    emails: DataFrame,
    probes: DataFrame,
    mx_records: DataFrame | None = None,
    disposable: Sequence[str] = tuple(fv.DISPOSABLE_DOMAINS),
) -> DataFrame:
    """Decide the status of ``(id, email)`` rows: ``new_status``, ``error``, ``is_disposable``.

    Format, disposable domain and missing mail host make an address invalid before its probe is
    looked at. Probes have one row per ``email_id``. Without ``mx_records`` every domain is taken
    to have a host. An address never probed stays unknown.
    """
    address = F.col("email")
    badly_formed = address.isNull() | ~address.contains("@")
    rows = emails.withColumn("_domain", F.lower(domain_part(address)))
    if mx_records is not None:
        hosts = primary_mx(mx_records).withColumnRenamed("domain", "_domain")
        rows = _with_hosts(rows, hosts)
    else:
        rows = rows.withColumn("primary_mx", F.lit("-"))
    outcome = probe_outcome(probes).select(
        F.col("email_id").alias("id"),
        "accepted",
        "probe_error",
        F.coalesce("catch_all_accepted", F.lit(False)).alias("_catch_all"),
    )
    throwaway = F.coalesce(F.col("_domain").isin(list(disposable)), F.lit(False))
    timeout = F.coalesce(F.col("probe_error").contains("timeout"), F.lit(False))
    status = (
        F.when(badly_formed | throwaway | F.col("primary_mx").isNull(), "invalid")
        .when(F.col("accepted").isNull() | timeout, "unknown")
        .when(F.col("accepted") & F.col("_catch_all"), "catch_all")
        .when(F.col("accepted"), "valid")
        .when(F.col("probe_error").isNotNull(), "unknown")
        .otherwise("invalid")
    )
    error = (
        F.when(badly_formed, "Invalid email format")
        .when(throwaway, "Disposable email domain")
        .when(F.col("primary_mx").isNull(), "No MX records found")
        .when(timeout, "SMTP timeout")
        .otherwise(F.col("probe_error"))
    )
    return rows.join(outcome, "id", "left").select(
        *emails.columns,
        status.alias("new_status"),
        error.alias("error"),
        (~badly_formed & throwaway).alias("is_disposable"),
    )


def verification_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count("*").alias("total"),
        *[
            C.count_where(F.col("new_status") == s).alias(s)
            for s in ("valid", "invalid", "catch_all", "unknown")
        ],
    )


def apply_verification(lead_emails: DataFrame, verified: DataFrame) -> DataFrame:
    changes = verified.select("id", F.col("new_status").alias("verification_status"))
    return patch(lead_emails, changes, "id", ["verification_status"])
