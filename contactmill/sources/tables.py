"""Reading and writing the pipeline tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill import schemas
from contactmill.functions.columns import norm


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A pipeline table from Parquet with its fixed schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def with_defaults(rows: DataFrame, name: str) -> DataFrame:
    """Fill the defaults of a table and normalise addresses, as an insert would."""
    for column, value in schemas.DEFAULTS.get(name, {}).items():
        filled = F.lit(value)
        if column in rows.columns:
            filled = F.coalesce(F.col(column), filled)
        rows = rows.withColumn(column, filled)
    if name == "lead_emails":
        rows = rows.withColumn("email", norm(F.col("email")))
    return rows


def _violations(name: str, columns: list[str]) -> Column:
    """Reasons a row breaks the table's rules, empty for a good row."""
    reasons = [
        F.when(F.col(c).isNull(), F.lit(f"{c} is missing"))
        for c in schemas.REQUIRED.get(name, [])
        if c in columns
    ] + [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(allowed), F.lit(f"{c} has an unknown value"))
        for c, allowed in schemas.ENUMS.get(name, {}).items()
        if c in columns
    ]
    return F.array_compact(F.array(*reasons))


def check_rows(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Split rows into accepted ones and rejected ones with their ``reasons``."""
    checked = rows.withColumn("reasons", _violations(name, rows.columns))
    good = F.size("reasons") == 0
    return checked.filter(good).drop("reasons"), checked.filter(~good)


def conform(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a table in order and type; absent ones are null."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.TABLES[name].fields
        ]
    )


def write_snapshot(rows: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> None:
    """Write a table as Parquet. A snapshot goes to a new folder; the one it was made from stays."""
    conform(rows, name).write.mode(mode).parquet(f"{folder}/{name}")


def append(rows: DataFrame, folder: str, name: str) -> None:
    accepted, _ = check_rows(with_defaults(rows, name), name)
    write_snapshot(accepted, folder, name, mode="append")


def write_bucketed(rows: DataFrame, name: str, table: str, buckets: int, sort: bool = True) -> None:
    """Save a table bucketed by its lead key.

    Tables bucketed alike join and aggregate per lead without a shuffle. Choose ``buckets`` so
    that one bucket fits an executor, a few hundred megabytes each. The rows are first shuffled to
    their buckets, so each bucket is one file.
    """
    key = schemas.BUCKET_KEYS[name]
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key)
    if sort:
        writer = writer.sortBy(key)
    writer.mode("errorifexists").format("parquet").saveAsTable(table)


def same_schema(rows: DataFrame, name: str) -> bool:
    want = schemas.TABLES[name]
    have = {f.name: f.dataType for f in rows.schema.fields}
    return reduce(and_, [have.get(f.name) == f.dataType for f in want.fields], True)
