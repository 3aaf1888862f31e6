"""Delivery events as streams: message status, daily counters, circuit breaker, new records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from contactmill.functions import columns as C
from contactmill.operators.sendlog import status_counts, with_breaker, with_rates
from contactmill.operators.snapshots import latest
from contactmill.sources.buckets import Folder, KeyStore


def file_stream(spark, schema, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def latest_status_stream(events: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Collect the last status per message below ``root``, to be read by :func:`read_latest_status`.

    Each micro-batch is reduced to one row per message and written to a folder of its own, so the
    work of a batch grows with the batch and not with all messages known. A repeated batch
    overwrites its folder. Statuses are merged by key and event time, so events of any lateness
    are taken.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _last_of_each(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


STATUS = "ses_message_id string, status string, at timestamp"


def _last_of_each(events: DataFrame) -> DataFrame:
    return (
        events.filter("ses_message_id IS NOT NULL")
        .groupBy("ses_message_id")
        .agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))
    )


def read_latest_status(spark: SparkSession, *roots: str) -> DataFrame:
    """The last status per message over the batches of one or more roots."""
    parts = spark.read.schema(STATUS).option("recursiveFileLookup", True).parquet(*roots)
    return _last_of_each(parts)


def compact_latest_status(spark: SparkSession, root: str, target: str) -> None:
    """Write the status of all batches below ``root`` as the one batch of the new folder ``target``.

    Read ``target`` from then on, along with the root of the batches that follow: a read goes through one row
    per message and not through every batch ever written.
    """
    read_latest_status(spark, root).write.parquet(f"{target}/batch=0")


def latest_status(events: DataFrame) -> DataFrame:
    """Batch form of the above."""
    return latest(events.filter("ses_message_id IS NOT NULL"), "ses_message_id", "status", "at")


def daily_sent(sends: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Sends per UTC day, on a stream or a table.

    Run a stream in update mode: the day that is going on comes out with each batch too. Rows later than
    ``lateness`` may be dropped.
    """
    counted = sends.withWatermark("sent_at", lateness) if sends.isStreaming else sends
    return (
        counted.groupBy(F.window("sent_at", "1 day").alias("w"))
        .agg(
            C.count_where(F.col("status") == "sent").alias("sent"), F.count("*").alias("attempted")
        )
        .select(F.col("w.start").alias("day"), "sent", "attempted")
    )


def hourly_status(sends: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Status counts per UTC hour, on a stream (in update mode) or a table."""
    counted = sends.withWatermark("sent_at", lateness) if sends.isStreaming else sends
    hourly = counted.groupBy(F.window("sent_at", "1 hour").alias("h")).agg(*status_counts())
    return hourly.withColumn("hour", F.col("h.start")).drop("h")


def rolling_breaker(hourly: DataFrame) -> DataFrame:
    """Circuit breaker over the trailing 24 hours, judged at every full hour, from :func:`hourly_status`.

    Only the hourly counts are put into the 24 windows each of them belongs to. The hourly counts of a stream
    are kept as files, a few dozen bytes per hour, and judged whenever they are read, the latest ones too.
    """
    names = [c for c in hourly.columns if c != "hour"]
    rated = with_rates(
        hourly.groupBy(F.window("hour", "24 hours", "1 hour").alias("w"))
        .agg(*[F.sum(c).alias(c) for c in names])
        .withColumn("judged_at", F.col("w.end"))
        .drop("w")
    )
    return with_breaker(rated).select(
        "judged_at", "total", "bounce_rate", "complaint_rate", "pause", "reason"
    )


def sliding_breaker(sends: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The circuit breaker over the trailing 24 hours as one streaming plan, on a stream (in update mode) or a table.

    Sends are counted in sliding windows, merged by each task before they are shuffled, so the state holds one row
    of counts for each window that ``lateness`` leaves open: 24 and those of the lateness.
    """
    counted = sends.withWatermark("sent_at", lateness) if sends.isStreaming else sends
    windows = counted.groupBy(F.window("sent_at", "24 hours", "1 hour").alias("w")).agg(*status_counts())
    rated = with_rates(windows.withColumn("judged_at", F.col("w.end")).drop("w"))
    return with_breaker(rated).select("judged_at", "total", "bounce_rate", "complaint_rate", "pause", "reason")


def split_late_stream(
    rows: DataFrame, time: str, lateness: str, root: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Part a stream into rows on time and late ones, below ``root``; nothing is dropped.

    A row is late where its time is more than ``lateness`` before the greatest time of the batches before,
    which is where a watermark of that lateness stands. That time is kept in one row per batch, of which a batch
    reads the last. Rows without a time are late. A repeated batch overwrites its folders.
    """
    spark, kind = rows.sparkSession, rows.schema[time].dataType.simpleString()

    def mark_of(batch_id: int):
        return spark.read.schema(f"mark {kind}").parquet(f"{root}/_marks/batch={batch_id}").first().mark

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = mark_of(batch_id - 1) if batch_id else None
        known = F.lit(mark).cast(kind)
        late = F.col(time).isNull() | F.coalesce(F.col(time) < known - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        target = f"{root}/batch={batch_id}"
        marked = batch.select("*", known.alias("mark"), late.alias("late"))
        marked.write.mode("overwrite").partitionBy("late").parquet(target)
        greatest = _split(spark, rows.schema, target).agg(F.greatest(F.max(time), known).alias("mark"))
        greatest.coalesce(1).write.mode("overwrite").parquet(f"{root}/_marks/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _split(spark: SparkSession, schema: T.StructType, path: str, *more: T.StructField) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, *more])).parquet(path)


def read_split(spark: SparkSession, schema: T.StructType, root: str) -> DataFrame:
    """All rows of :func:`split_late_stream` with ``mark``, ``batch`` and ``late``; filters on the last two skip folders."""
    mark = T.StructField("mark", T.TimestampType())
    more = [T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())]
    return _split(spark, schema, root, mark, *more)


def late_report(split: DataFrame, time: str) -> DataFrame:
    """Per batch: rows, late rows, and by how many milliseconds the latest one is behind the greatest time before."""
    behind = F.floor((F.unix_micros("mark") - F.unix_micros(time)) / 1000)
    return split.groupBy("batch").agg(
        F.count("*").alias("rows"), C.count_where(F.col("late")).alias("late"),
        F.max(F.when(F.col("late"), behind)).alias("worst_ms"),
    )


def corrected_daily(counts: DataFrame, late: DataFrame) -> DataFrame:
    """Daily counts of a stream, with the sends that came too late for it added."""
    both = counts.unionByName(daily_sent(late.where("sent_at IS NOT NULL")))
    return both.groupBy("day").agg(F.sum("sent").alias("sent"), F.sum("attempted").alias("attempted"))


RECORD_KEYS = ["source", "source_id"]


def new_records(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Records of a table by source and source id, each once, without those already known."""
    fresh = records.dropDuplicates(RECORD_KEYS)
    return fresh if known is None else fresh.join(known.select(*RECORD_KEYS).distinct(), RECORD_KEYS, "left_anti")


def new_records_stream(
    records: DataFrame, root: str, checkpoint: str, known: DataFrame | None = None, buckets: int = 64,
    horizon: str = "1 day", fold: int = 16, **trigger,
) -> StreamingQuery:
    """Collect new records of a stream below ``root``, however late a repetition comes.

    Repetitions that arrive within ``horizon`` are told by the state of the stream, which forgets a key after that
    time; it goes by the time of arrival, so no record is too late. What passes is held against the keys of
    all earlier batches in ``root/_keys``, of which only the buckets of the batch's keys are read. ``known``
    records are put there once, ahead of the first batch. A repeated batch overwrites its folders.
    """
    spark, keys = records.sparkSession, T.StructType([records.schema[k] for k in RECORD_KEYS])
    store = KeyStore(spark, f"{root}/_keys", keys, buckets, fold)
    arrived = records.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    recent = arrived.dropDuplicatesWithinWatermark(RECORD_KEYS).drop("_arrived")

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0 and known is not None:
            store.add(known, -1)
        # Written once, so that the state is not gone through again for each use.
        incoming, target = f"_incoming/batch={batch_id}", f"{root}/batch={batch_id}"
        new_records(batch).write.mode("overwrite").parquet(f"{root}/{incoming}")
        read = spark.read.schema(records.schema)
        store.unseen(read.parquet(f"{root}/{incoming}"), batch_id).write.mode("overwrite").parquet(target)
        store.add(read.parquet(target), batch_id)
        store.compact(batch_id)
        Folder(spark, root).drop(incoming)

    return (
        recent.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
