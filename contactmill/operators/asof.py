"""As-of joins and what is looked up with them: limits that change over time, one schedule per sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], span: str = "month") -> DataFrame:
    """Each left row with the values of the last right row of its key that is not later.

    Both sides are laid out by key and calendar ``span`` and gone through once in the order of time, so no row meets
    more than its neighbour, and a key with very many rows is spread over its spans. What a span begins with is
    carried over from one row per key and span. Right rows of one key and time: the greatest values
    win. Left rows with a null key or time, and those ahead of all right rows, get nulls. The values' names must
    not be columns of ``left``.
    """
    found = F.struct(*[F.col(v) for v in values])
    known = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(found).alias("_found"))
    known = known.withColumn("_span", F.date_trunc(span, at))
    kept = F.struct(*[F.col(c) for c in left.columns])
    rows = left.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_span", F.date_trunc(span, at))

    marks = rows.select(key, "_span").distinct().withColumn("_found", F.lit(None).cast(known.schema["_found"].dataType))
    last = known.groupBy(key, "_span").agg(F.max_by("_found", at).alias("_found"))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    steps = marks.unionByName(last).groupBy(key, "_span").agg(F.max("_found").alias("_found"))
    begun = steps.select(key, "_span", F.last("_found", ignorenulls=True).over(before).alias("_begun"))

    both = rows.select(key, at, "_span", F.lit(1).alias("_side"), kept.alias("_row"), F.lit(None).cast(known.schema["_found"].dataType).alias("_found"))
    both = both.unionByName(known.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(key, "_span").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("_last", F.last("_found", ignorenulls=True).over(so_far)).where("_side = 1")
    joined = joined.join(begun, [key, "_span"]).withColumn("_last", F.coalesce("_last", "_begun"))
    out = joined.select("_row.*", *[F.col("_last")[v].alias(v) for v in values])
    rest = left.where(F.col(key).isNull() | F.col(at).isNull())
    nothing = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    return out.unionByName(rest.select("*", *nothing))


def _later(start: str, days: Column) -> Column:
    return F.col(start) + F.make_dt_interval(days.cast("int"))


def limit_steps(starts: DataFrame, schedule: DataFrame, base: int) -> DataFrame:
    """The moments at which a sender's limit changes: ``(sender, at, daily_limit)``.

    ``starts`` has ``(sender, warmup_start)``, one row per sender, ``schedule`` its entries ``(sender, day,
    daily_limit)``, of which day 1 begins at the start. The first entry holds from the start on, and the base limit
    from the day after the last one. A sender without entries has the base limit from the start on.
    """
    begun = starts.where("warmup_start IS NOT NULL")
    ends = schedule.groupBy("sender").agg(F.min_by("daily_limit", "day").alias("first"), F.max("day").alias("last"))
    entries = begun.join(schedule, "sender").where("day > 1").select(
        "sender", _later("warmup_start", F.col("day") - 1).alias("at"), F.col("daily_limit").cast("int").alias("daily_limit")
    )
    edges = begun.join(ends, "sender", "left").select("sender", F.explode(F.array(
        F.struct(F.col("warmup_start").alias("at"), F.coalesce("first", F.lit(base)).cast("int").alias("daily_limit")),
        F.struct(_later("warmup_start", F.coalesce("last", F.lit(0))).alias("at"), F.lit(base).cast("int").alias("daily_limit")),
    )).alias("edge")).select("sender", "edge.*")
    # A start that is an entry's own day is one step; so is an empty schedule's end.
    return entries.unionByName(edges).dropDuplicates(["sender", "at"])


def scheduled_limits(moments: DataFrame, starts: DataFrame, schedule: DataFrame, base: int) -> DataFrame:
    """Add ``daily_limit`` to rows ``(sender, at)``: the limit of the sender's schedule in force at that time.

    Ahead of a sender's start it is 0; a sender without a start, or a null one, has the base limit throughout.
    """
    steps = limit_steps(starts, schedule, base)
    found = asof_join(moments, steps, "sender", "at", ["daily_limit"])
    warming = starts.where("warmup_start IS NOT NULL").select("sender", F.lit(True).alias("_warming")).distinct()
    ahead = F.when(F.col("_warming"), F.lit(0)).otherwise(F.lit(base))
    return found.join(warming, "sender", "left").select(*moments.columns, F.coalesce("daily_limit", ahead).cast("int").alias("daily_limit"))
