"""The streaming operators run over an events folder until it is read, with results in files.

State and results go below the shared checkpoint folder, a new one for every run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.session import checkpoint_root, configure
from contactmill.streaming import backoff, delivery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.file_stream(configure(spark), EVENTS, f"{folder}/events*.parquet")


def _status() -> Column:
    kind, failed = F.col("event_type"), F.when(F.col("value") < 20, "complained").otherwise("bounced")
    return (
        F.when(kind == "signup", "sent").when(kind == "purchase", "delivered")
        .when(kind == "view", "opened").when(kind == "click", "clicked").otherwise(failed)
    )


def _sends(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        F.concat(F.lit("m"), (F.col("event_id") % 2000).cast("string")).alias("ses_message_id"),
        _status().alias("status"),
        F.col("ts").cast("timestamp").alias("sent_at"),
    )


def latest_rows(stream: DataFrame, keys: list[str], where: str) -> DataFrame:
    """Run an aggregation to its end in update mode and return the last row of each key.

    Each micro-batch writes the rows it changed to a folder of its own; a repeated batch overwrites it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={batch_id}")

    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{where}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{where}/out")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)


def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    where = _folder(spark)
    events = _sends(spark, folder).withColumnRenamed("sent_at", "at")
    delivery.latest_status_stream(events, f"{where}/status", f"{where}/checkpoint").awaitTermination()
    delivery.compact_latest_status(spark, f"{where}/status", f"{where}/compact")
    return delivery.read_latest_status(spark, f"{where}/compact").select("ses_message_id", "status")


def daily_sent(spark: SparkSession, folder: str) -> DataFrame:
    return latest_rows(delivery.daily_sent(_sends(spark, folder)), ["day"], _folder(spark))


def rolling_breaker(spark: SparkSession, folder: str) -> DataFrame:
    hourly = latest_rows(delivery.hourly_status(_sends(spark, folder)), ["hour"], _folder(spark))
    return delivery.rolling_breaker(hourly)


def sliding_breaker(spark: SparkSession, folder: str) -> DataFrame:
    return latest_rows(delivery.sliding_breaker(_sends(spark, folder)), ["judged_at"], _folder(spark))


#: Micro-batches into which the events are dealt, by id, where rows have to come late.
PARTS = 4


def _split_sends(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The sends of the events, dealt to PARTS batches in turn and split by lateness; and the folder of the split."""
    where = _folder(spark)
    events = configure(spark).read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    for n in range(PARTS):
        events.where(F.col("event_id") % PARTS == n).write.parquet(f"{where}/in/part{n}")
        stream = delivery.file_stream(spark, EVENTS, f"{where}/in/part*")
        sends = stream.select(F.col("event_id"), _status().alias("status"), F.col("ts").cast("timestamp").alias("sent_at"))
        delivery.split_late_stream(sends, "sent_at", "1 hour", f"{where}/split", f"{where}/split-checkpoint").awaitTermination()
    return delivery.read_split(spark, sends.schema, f"{where}/split"), where


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.late_report(_split_sends(spark, folder)[0], "sent_at")


def corrected_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The daily counter over what came in time, then with the late rows added."""
    split, where = _split_sends(spark, folder)
    kept = T.StructType([f for f in split.schema.fields if f.name not in ("batch", "late")])
    in_time = delivery.file_stream(spark, kept, f"{where}/split/batch=*/late=false")
    counts = latest_rows(delivery.daily_sent(in_time), ["day"], f"{where}/counts")
    return delivery.corrected_daily(counts, split.where("late"))


def new_records(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    rows = _events(spark, folder).select(
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("source_id"),
        F.col("ts").cast("timestamp").alias("seen_at"),
    )
    where = _folder(spark)
    delivery.new_records_stream(rows, f"{where}/out", f"{where}/checkpoint", known).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{where}/out").select("source", "source_id")


def _fetches(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, folder).select(
        F.col("event_id").alias("fetch_id"),
        F.concat(F.lit("site"), (F.col("user_id") % 100).cast("string"), F.lit(".example.net")).alias("domain"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        F.when(kind == "signup", 403).when(kind == "error", F.lit(None)).otherwise(200).alias("status_code"),
        ((kind == "click") & (F.col("value") < 5)).alias("bot_page"),
        (kind == "error").alias("network_error"),
    )


def domain_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Final state per domain."""
    return latest_rows(backoff.domain_state(_fetches(spark, folder)), ["domain"], _folder(spark))


def expiring_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Final state per domain, and whether it has expired by the end: after half a day, 10 minutes late at most."""
    states = backoff.expiring_domain_state(_fetches(spark, folder), "10 minutes", 720)
    return latest_rows(states, ["domain"], _folder(spark))
