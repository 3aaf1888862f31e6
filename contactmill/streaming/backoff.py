"""When a domain may be fetched again, from its fetch log.

A refusal (403, 429 or a bot page) blocks a domain for 30 minutes. From the third network failure
on, each one asks for five minutes of rest. Failures add up; a success does not reset them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contactmill.functions import fixed_values as fv


def is_refusal() -> Column:
    return F.coalesce(F.col("status_code").isin(403, 429), F.lit(False)) | F.coalesce(
        F.col("bot_page"), F.lit(False)
    )


def backoff_history(fetches: DataFrame) -> DataFrame:
    """State of the domain after each fetch of ``(fetch_id, domain, fetched_at, status_code, bot_page,
    network_error)``.

    Running values per domain. To keep a busy domain from ending up in one task, the log is cut
    into hours: the window of an hour holds only its own rows, and starts from the totals of the
    hours before, which are one row per domain and hour.
    """
    marked = (
        fetches.withColumn("_hour", F.date_trunc("hour", "fetched_at"))
        .withColumn("_blocked_at", F.when(is_refusal(), F.col("fetched_at")))
        .withColumn("_failed_at", F.when(F.col("network_error"), F.col("fetched_at")))
        .withColumn("_failed", F.when(F.col("network_error"), 1).otherwise(0))
    )
    before = W.partitionBy("domain").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    hours = (
        marked.groupBy("domain", "_hour")
        .agg(
            F.max("_blocked_at").alias("_b"), F.max("_failed_at").alias("_f"), F.sum("_failed").alias("_n")
        )
        .select(
            "domain",
            "_hour",
            F.max("_b").over(before).alias("_b0"),
            F.max("_f").over(before).alias("_f0"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        )
    )
    so_far = (
        W.partitionBy("domain", "_hour").orderBy("fetched_at", "fetch_id").rowsBetween(W.unboundedPreceding, 0)
    )
    rows = (
        marked.withColumn("_b1", F.max("_blocked_at").over(so_far))
        .withColumn("_f1", F.max("_failed_at").over(so_far))
        .withColumn("_n1", F.sum("_failed").over(so_far))
        .join(hours, ["domain", "_hour"])
    )
    blocked_at = F.greatest("_b0", "_b1")
    failed_at = F.greatest("_f0", "_f1")
    failures = F.col("_n0") + F.col("_n1")
    return rows.select("domain", "fetched_at", "fetch_id", *_verdict(F.col("fetched_at"), blocked_at, failures, failed_at))


def _verdict(at: Column, blocked_at: Column, failures: Column, failed_at: Column) -> list[Column]:
    unblocked = blocked_at + F.expr(f"INTERVAL {fv.BOT_BLOCK_MINUTES} MINUTES")
    rested = F.when(
        failures >= fv.TIMEOUTS_BEFORE_BACKOFF,
        failed_at + F.expr(f"INTERVAL {fv.TIMEOUT_BACKOFF_MINUTES} MINUTES"),
    )
    blocked = F.coalesce(at < unblocked, F.lit(False))
    resting = F.coalesce(at < rested, F.lit(False))
    again = F.greatest(F.when(blocked, unblocked), F.when(resting, rested))
    return [blocked.alias("blocked"), resting.alias("backing_off"), again.alias("open_again_at")]


def domain_state(fetches: DataFrame) -> DataFrame:
    """Where each domain stands after its log, on a table or a stream. One aggregation, combined before the shuffle.

    On a stream the state is one small row of maxima and a count per domain, so a busy domain is read batch
    by batch and never gathered. In update mode each micro-batch gives the states it changed.
    """
    rests_from = F.max(F.when(F.col("network_error"), F.col("fetched_at")))
    failures = F.count_if("network_error")
    return fetches.groupBy("domain").agg(
        F.max("fetched_at").alias("seen_at"),
        failures.alias("failures"),
        (F.max(F.when(is_refusal(), F.col("fetched_at"))) + F.expr(f"INTERVAL {fv.BOT_BLOCK_MINUTES} MINUTES")).alias(
            "blocked_until"
        ),
        F.when(
            failures >= fv.TIMEOUTS_BEFORE_BACKOFF,
            rests_from + F.expr(f"INTERVAL {fv.TIMEOUT_BACKOFF_MINUTES} MINUTES"),
        ).alias("rests_until"),
    )


#: Microseconds that stand for "never" in the expiring state.
NEVER = -(1 << 62)
_SUMMARY = "domain string, fetched_at timestamp, seen long, refused long, failed long, failures long"
_STATE = "seen long, refused long, failed long, failures long"
_CHANGE = "domain string, seen long, refused long, failed long, failures long, expired boolean"


def expiring_domain_state(fetches: DataFrame, lateness: str = "1 hour", keep_minutes: int = 1440) -> DataFrame:
    """As `domain_state` on a stream, with state that ends: update mode, one row per domain that a batch changed.

    A domain holds state only after a refusal or a network failure, until the watermark (newest fetch less
    ``lateness``) has passed the end of its block, the end of its rest and its last failure by
    ``keep_minutes``. Its last row then comes again with ``expired`` true, and its failures count from zero from
    the next batch on. So state grows with the domains lately in trouble, not with all ever fetched. While
    nothing expires and nothing is late, the other columns are those of `domain_state`; for a domain without
    trouble ``seen_at`` is that of the batch.

    Each task first sums up its rows per domain, so a busy domain sends one row per Arrow batch. A summary whose
    newest fetch is older than the watermark is dropped. Null domains and times are left out.
    """
    block, rest, enough = fv.BOT_BLOCK_MINUTES * 60_000_000, fv.TIMEOUT_BACKOFF_MINUTES * 60_000_000, fv.TIMEOUTS_BEFORE_BACKOFF
    never, keep = NEVER, keep_minutes * 60_000_000

    # Both functions are local and name no other of this package, so their code travels with the task.
    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tops = {c: (c, "max") for c in ("fetched_at", "seen", "refused", "failed")}
            yield batch.groupby("domain", as_index=False).agg(**tops, failures=("failures", "sum"))

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, refused, failed, failures = state.get if state.exists else (never, never, never, 0)
        expired = state.hasTimedOut
        if expired:
            state.remove()
        else:
            for part in parts:
                seen, refused = max(seen, int(part["seen"].max())), max(refused, int(part["refused"].max()))
                failed, failures = max(failed, int(part["failed"].max())), failures + int(part["failures"].sum())
            if max(refused, failed) > never:
                ends = max(refused + block, failed + (rest if failures >= enough else 0)) + keep
                state.update((seen, refused, failed, failures))
                state.setTimeoutTimestamp(max(ends // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], seen, refused, failed, failures, expired)], columns=["domain", "seen", "refused", "failed", "failures", "expired"])

    micros = F.unix_micros(F.col("fetched_at"))
    failure = F.coalesce("network_error", F.lit(False))
    rows = fetches.where("domain is not null and fetched_at is not null").select(
        "domain", "fetched_at", micros.alias("seen"), F.when(is_refusal(), micros).otherwise(NEVER).alias("refused"),
        F.when(failure, micros).otherwise(NEVER).alias("failed"), failure.cast("long").alias("failures"),
    )
    changes = (
        rows.mapInPandas(summaries, _SUMMARY)
        .withWatermark("fetched_at", lateness)
        .groupBy("domain")
        .applyInPandasWithState(advance, _CHANGE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )
    return changes.select(
        "domain", F.timestamp_micros("seen").alias("seen_at"), "failures",
        F.when(F.col("refused") > NEVER, F.timestamp_micros(F.col("refused") + block)).alias("blocked_until"),
        F.when(F.col("failures") >= enough, F.timestamp_micros(F.col("failed") + rest)).alias("rests_until"), "expired",
    )
