"""Numbers and running sums over whole ordered tables, without one task that sees all rows.

Rows are dealt to ranges of the order and sorted there. The counts of the ranges are few, and their running sum is
what a range starts from. Running sums work alike on blocks of consecutive ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactmill.session import stored

#: Ranks of a block of :func:`sum_ahead`. One task sums a block; one sums the totals of all blocks.
BLOCK = 100_000
_IN_TASK = 33  # bits of monotonically_increasing_id that count the rows of a task


def _starts(totals: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``(key, name)``: the sum of ``value`` over smaller keys. There is one row per range or block."""
    ahead = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(ahead), F.lit(0)).alias(name))


def numbered(
    rows: DataFrame, order: Sequence[Column], name: str = "rank", ranges: int | None = None, root: str | None = None
) -> DataFrame:
    """Rows with their number from 1 in ``order``.

    The order should end with a unique column: rows that are equal in it fall into one range, and are numbered as
    they come. The sorted ranges are written to the shared folder, so numbers stay the same when executors are
    lost. One shuffle moves the rows; the counts of the ranges are joined to them.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = stored(sorted_rows.withColumn("_place", place), root)
    kept = kept.withColumn("_range", F.shiftright("_place", _IN_TASK))
    starts = _starts(kept.groupBy("_range").agg(F.count("*").alias("_n")), "_range", "_n", "_start")
    inside = F.col("_place").bitwiseAND(F.lit((1 << _IN_TASK) - 1))
    return (
        kept.join(starts, "_range")
        .withColumn(name, F.col("_start") + inside + 1)
        .drop("_range", "_place", "_start")
    )


def sum_ahead(rows: DataFrame, value: Column, name: str, rank: str = "rank", block: int = BLOCK) -> DataFrame:
    """Add the sum of ``value`` over the rows of lower rank; 0 for the first. Null values count as 0.

    ``rank`` numbers all rows from 1 without gaps, as :func:`numbered` does.
    """
    cut = rows.withColumn("_value", F.coalesce(value, F.lit(0))).withColumn(
        "_block", F.floor((F.col(rank) - 1) / block)
    )
    totals = cut.groupBy("_block").agg(F.sum("_value").alias("_total"))
    ahead = W.partitionBy("_block").orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum("_value").over(ahead), F.lit(0)))
        .join(_starts(totals, "_block", "_total", "_start"), "_block")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_start")
    )
