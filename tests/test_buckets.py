"""Tables kept by bucket: what an update rewrites, what it leaves, and what survives a lost writer."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contactmill.sources.buckets import BucketedTable, KeyStore, bucket_of


def files(table):
    """Data files of the table with their times, by bucket."""
    found = {}
    for path in Path(table.path, "rows").glob("bucket=*/*.parquet"):
        found.setdefault(int(path.parent.name.split("=")[1]), {})[path.name] = os.stat(path).st_mtime_ns
    return found


@pytest.fixture()
def table(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "concat('name', id) as name", "if(id % 3 = 0, null, id) as n")
    return BucketedTable.create(rows, f"{tmp_path}/t", ["id"], 64)


def state(table):
    return {r["id"]: (r["name"], r["n"]) for r in table.read().collect()}


def test_a_patch_of_ten_ids_rewrites_at_most_ten_buckets(spark, table):
    before, rows = files(table), state(table)
    ids = [3, 14, 159, 265, 358, 979, 323, 846, 1999, 5000]
    changes = spark.createDataFrame([(i, f"new{i}") for i in ids], "id long, name string")
    touched = table.patch(changes, ["name"])
    after = files(table)
    changed = {b for b in before if before[b] != after.get(b)}
    assert changed <= set(touched) and 0 < len(changed) <= 10
    assert all(before[b] == after[b] for b in before if b not in touched)
    assert state(table) == rows | {i: (f"new{i}", rows[i][1]) for i in ids if i in rows}


def test_reads_and_lookups_scan_only_their_buckets(spark, table):
    plan = table.read([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    keys = spark.createDataFrame([(7,), (7,), (4000,), (None,)], "id long")
    found = table.lookup(keys)
    assert [tuple(r) for r in found.collect()] == [(7, "name7", 7)]
    scan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket#" in scan and all(str(b) in scan for b in table.touched(keys))
    read = table.read([1, 2]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {Path(r.f).parent.name for r in read} == {"bucket=1", "bucket=2"}


def test_deletes_may_empty_a_bucket(spark, table):
    rows = state(table)
    gone = table.read([5]).select("id")
    ids = {r.id for r in gone.collect()}
    assert table.delete(gone) == [5]
    assert 5 not in files(table) and state(table) == {i: v for i, v in rows.items() if i not in ids}
    assert table.delete(spark.createDataFrame([], "id long")) == []
    table.append(spark.createDataFrame([(min(ids), "back", None)], "id long, name string, n long"))
    assert state(table)[min(ids)] == ("back", None)


def test_rows_of_other_keys_are_refused(spark, table):
    rows = state(table)
    with pytest.raises(Exception, match="not given"):
        table.merge(spark.createDataFrame([(1,)], "id long"), lambda old, new: old.withColumn("id", F.col("id") + 1))
    again = BucketedTable(spark, table.path)
    assert state(again) == rows and not again.folder.has("pending")


def test_a_writer_lost_after_the_mark_leaves_a_move_to_finish(spark, table, monkeypatch):
    rows = state(table)
    changes = spark.createDataFrame([(i, "x") for i in range(40)], "id long, name string")
    moved = []

    def lost(name, to, move=table.folder.move):
        if len(moved) == 3:
            raise OSError("lost")
        moved.append(name)
        move(name, to)

    monkeypatch.setattr(table.folder, "move", lost)
    with pytest.raises(OSError):
        table.patch(changes, ["name"])
    assert table.folder.has("pending/_ready")
    again = BucketedTable(spark, table.path)
    assert state(again) == rows | {i: ("x", rows[i][1]) for i in range(40)}
    assert not again.folder.has("pending")


def test_a_writer_lost_before_the_mark_changes_nothing(spark, table, monkeypatch):
    rows = state(table)
    monkeypatch.setattr(table.folder, "mark", lambda name: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.delete(spark.range(100).select("id"))
    assert state(BucketedTable(spark, table.path)) == rows


def test_keys_of_several_columns_nulls_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), (None, None, 2), ("a", "b", 3)], "k string, l string, v int")
    table = BucketedTable.create(rows, f"{tmp_path}/t", ["k", "l"], 8)
    assert sorted(r.v for r in table.read().collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        BucketedTable.create(rows.withColumnRenamed("v", "bucket"), f"{tmp_path}/u", ["k"], 8)
    empty = BucketedTable.create(rows.limit(0), f"{tmp_path}/e", ["k"], 8)
    assert empty.read().count() == 0
    empty.append(rows)
    assert empty.read().count() == 3


def test_key_store_folds_old_batches(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, l string").schema
    store = KeyStore(spark, f"{tmp_path}/keys", schema, 2, fold=3)
    assert store.unseen(spark.createDataFrame([("a", "b")], schema), 0).count() == 1
    for n in range(9):
        store.add(spark.createDataFrame([(f"k{n}", None), (f"k{n}", "x"), ("again", "y")], schema), n)
        store.compact(n)
    folders = [len(list(Path(p).glob("batch=*"))) for p in Path(store.path).glob("bucket=*")]
    assert max(folders) <= 5
    rows = spark.createDataFrame([("k0", None), ("k8", "x"), ("k9", "x"), ("k0", "z"), ("again", "y")], schema)
    assert {tuple(r) for r in store.unseen(rows, 9).collect()} == {("k9", "x"), ("k0", "z")}
    # A batch that is repeated does not meet the keys it noted itself.
    assert {r.k for r in store.unseen(rows, 8).collect()} == {"k8", "k9", "k0"}
    at = bucket_of(["k", "l"], 2)
    assert rows.select(at).where(at.isNull()).count() == 0
