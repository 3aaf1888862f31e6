"""Keyed updates of a table as a new snapshot: the batch form of UPDATE, DELETE and upsert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.columns import moment


def patch(
    table: DataFrame,
    changes: DataFrame,
    key: str = "id",
    columns: Sequence[str] = (),
    present: Mapping[str, str] | None = None,
) -> DataFrame:
    """Overwrite ``columns`` of the rows whose key occurs in ``changes``.

    ``changes`` has one row per key. A null there keeps the old value, unless ``present`` names a
    boolean column of ``changes`` that tells whether the value was given (so null can be written).
    """
    present = present or {}
    flags = sorted(set(present.values()))
    new = changes.select(
        key,
        *[F.col(c).alias("_new_" + c) for c in columns],
        *[F.col(f).alias("_flag_" + f) for f in flags],
    )
    joined = table.join(new, key, "left")

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        given = F.col("_new_" + c).cast(table.schema[c].dataType)
        if c in present:
            return F.when(F.col("_flag_" + present[c]), given).otherwise(F.col(c)).alias(c)
        return F.coalesce(given, F.col(c)).alias(c)

    return joined.select(*[value(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str = "id", in_table: str | None = None) -> DataFrame:
    """Rows whose key is not listed. With ``in_table`` a child table loses the rows of deleted
    parents, which gives the result of a cascade."""
    name = in_table or key
    gone = keys.select(F.col(key).alias(name)).distinct()
    return table.join(gone, name, "left_anti")


def latest(events: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The last value per key. Combined ahead of the shuffle; ties go to the greater value."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value))


def set_stage(leads: DataFrame, changes: DataFrame, as_of: datetime | str) -> DataFrame:
    """Set ``pipeline_stage`` from ``(id, pipeline_stage)`` rows."""
    stamped = changes.select("id", "pipeline_stage").withColumn("updated_at", moment(as_of))
    columns = [c for c in ("pipeline_stage", "updated_at") if c in leads.columns]
    return patch(leads, stamped, "id", columns)
