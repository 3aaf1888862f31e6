"""Tables kept by hash bucket of a key, of which an update rewrites the touched buckets only.

``rows/bucket=B`` holds the rows whose key hashes to B, ``layout`` the key, the number of buckets and the schema.
An update reads the buckets of its keys, writes them anew below ``pending``, marks that folder as ready and puts
the new buckets in place one by one. A writer that dies before the mark leaves the table as it was; one that dies
after it leaves a move that the next reader or writer finishes, so each update takes effect once. Tables have one
writer at a time.

Choose the number of buckets so that one holds a few hundred megabytes: an update of k rows then reads and writes
at most k of them, whatever the size of the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.operators import snapshots
from contactmill.session import stored

BUCKET = "bucket"
_LAYOUT = "keys array<string>, buckets int, schema string"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row. Null keys have a bucket as well."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _in_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by bucket, large buckets in several files, sorted by key: a filter on keys skips most of a file."""
    return rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *keys)


class Folder:
    """A path of any file system that Spark's own settings reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """The names in a folder, none where there is no such folder."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self.has(name) else []

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def mark(self, name: str) -> None:
        self._fs.createNewFile(self._at(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} cannot be moved to {to}")


class BucketedTable:
    """A table below a path, made by :meth:`create`."""

    def __init__(self, spark: SparkSession, path: str):
        layout = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
        self.spark, self.path, self.keys, self.buckets = spark, path, list(layout["keys"]), layout["buckets"]
        self.schema = T.StructType.fromJson(json.loads(layout["schema"]))
        self.folder = Folder(spark, path)
        self._finish()

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> BucketedTable:
        """Write rows as a new table. Rows are dealt to their buckets once; large buckets are split into files."""
        spark = rows.sparkSession
        if BUCKET in rows.columns or buckets < 1:
            raise ValueError(f"no column may be named {BUCKET}, and there is at least one bucket")
        dealt = rows.withColumn(BUCKET, bucket_of(keys, buckets))
        _in_order(dealt, keys).write.partitionBy(BUCKET).parquet(f"{path}/rows")
        layout = [(list(keys), buckets, rows.schema.json())]
        spark.createDataFrame(layout, _LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path)

    def _all(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; other folders are not listed as inputs of the scan."""
        self._finish()
        rows = self._all()
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(list(buckets)))
        return rows.drop(BUCKET)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of some rows, at most all buckets."""
        each = rows.select(bucket_of(self.keys, self.buckets).alias(BUCKET)).distinct()
        return sorted(r[0] for r in each.collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with the keys of ``keys``, from their buckets only."""
        keys = stored(keys.select(*self.keys).distinct())
        return self.read(self.touched(keys)).join(keys, self.keys, "left_semi")

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of the changes' keys by ``apply(their rows, changes)``; returns these buckets.

        ``changes`` has the key columns. The result has the columns of the table, and no keys but those of the
        rows and the changes given.
        """
        changes = stored(changes)
        buckets = self.touched(changes)
        if not buckets:
            return []
        new = apply(self.read(buckets), changes)
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        at = bucket_of(self.keys, self.buckets)
        stray = F.raise_error(F.lit("a merge gave rows of keys that it was not given")).cast("int")
        rows = new.withColumn(BUCKET, F.when(at.isin(buckets), at).otherwise(stray))
        _in_order(rows, self.keys).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/pending")
        for b in buckets:  # a bucket without rows is put in place too
            self.folder.make(f"pending/{BUCKET}={b}")
        self.folder.mark("pending/_ready")
        self._finish()
        return buckets

    def _finish(self) -> None:
        """Put ready buckets in place; what was not finished goes."""
        if not self.folder.has("pending"):
            return
        if self.folder.has("pending/_ready"):
            for name in self.folder.names("pending"):
                if name.startswith(f"{BUCKET}="):
                    self.folder.drop(f"rows/{name}")
                    if self.folder.names(f"pending/{name}"):
                        self.folder.move(f"pending/{name}", f"rows/{name}")
                    else:
                        self.folder.drop(f"pending/{name}")
            self.spark.catalog.refreshByPath(f"{self.path}/rows")
        self.folder.drop("pending")

    def patch(self, changes: DataFrame, columns: Sequence[str], present=None) -> list[int]:
        """As :func:`snapshots.patch` by the one key of the table."""
        (key,) = self.keys
        return self.merge(changes, lambda rows, new: snapshots.patch(rows, new, key, columns, present))

    def delete(self, keys: DataFrame) -> list[int]:
        """As :func:`snapshots.delete` by the one key of the table."""
        (key,) = self.keys
        return self.merge(keys, lambda rows, gone: snapshots.delete(rows, gone, key))

    def append(self, rows: DataFrame) -> list[int]:
        """Add rows, whatever their keys."""
        return self.merge(rows, lambda old, new: old.unionByName(new.select(*old.columns)))


class KeyStore:
    """Keys seen by a stream, by bucket and micro-batch.

    A batch adds one folder to each bucket it touches, and a repeated batch overwrites its own. Old batches of
    a bucket are folded into one, so a batch reads one folder and a few small ones of each bucket it touches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int, fold: int = 16):
        self.spark, self.path, self.schema, self.buckets, self.fold = spark, path, schema, buckets, fold
        self.keys = schema.fieldNames()
        self.folder = Folder(spark, path)

    def _read(self) -> DataFrame:
        extra = [T.StructField(BUCKET, T.IntegerType()), T.StructField("batch", T.LongType())]
        return self.spark.read.schema(T.StructType([*self.schema.fields, *extra])).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            BUCKET, "batch"
        ).parquet(self.path)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Note the keys of a batch."""
        keys = rows.select(*self.keys).distinct()
        self._write(keys.withColumn(BUCKET, bucket_of(self.keys, self.buckets)).withColumn("batch", F.lit(batch).cast("long")))

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows whose keys no earlier batch has noted. Null parts of a key equal each other."""
        if not self.folder.has(""):
            return rows
        at = [r[0] for r in rows.select(bucket_of(self.keys, self.buckets)).distinct().collect()]
        seen = self._read().where(F.col(BUCKET).isin(at) & (F.col("batch") < batch)).select(*self.keys)
        same = [rows[k].eqNullSafe(seen[k]) for k in self.keys]
        return rows.join(seen, same, "left_anti")

    def compact(self, batch: int) -> None:
        """Fold the batches before ``batch``, all of them finished, where a bucket has more than ``fold``."""
        for name in self.folder.names(""):
            if not name.startswith(f"{BUCKET}="):
                continue
            old = sorted(int(b.split("=")[1]) for b in self.folder.names(name) if b.startswith("batch="))
            old = [b for b in old if b < batch]
            if len(old) <= self.fold:
                continue
            rows = self._read().where((F.col(BUCKET) == int(name.split("=")[1])) & F.col("batch").isin(old))
            folded = rows.select(*self.keys).distinct()
            self._write(folded.selectExpr("*", f"{int(name.split('=')[1])} as {BUCKET}", f"{old[-1]}L as batch"))
            for b in old[:-1]:
                self.folder.drop(f"{name}/batch={b}")
            self.spark.catalog.refreshByPath(self.path)
