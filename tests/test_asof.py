"""As-of joins and schedules against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from contactmill.operators import asof
from contactmill.operators import sequences as G

START = datetime(2024, 1, 1)


def test_asof_join_equals_brute_force(spark):
    rng = random.Random(4)
    when = lambda: START + timedelta(hours=rng.randint(0, 24 * 120))
    left = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([when(), when(), None])) for i in range(300)]
    right = [(rng.choice(["a", "b", None]), rng.choice([when(), when(), None]), rng.choice([None, 1, 2, 3])) for _ in range(80)]
    left += [(900, "a", right[0][1]), (901, right[1][0], right[1][1]), (901, right[1][0], right[1][1])]

    def value(key, at):
        known = [(t, v is not None, v or 0) for k, t, v in right if k is not None and t is not None and k == key and at is not None and t <= at]
        if not known:
            return None
        _, given, v = max(known)
        return v if given else None

    frame = spark.createDataFrame(left, "id int, key string, at timestamp").withColumn("extra", F.lit("x"))
    steps = spark.createDataFrame(right, "key string, at timestamp, v int")
    for span in ("month", "day", "year"):
        out = asof.asof_join(frame, steps, "key", "at", ["v"], span)
        got = [(r.id, r.v) for r in out.collect()]
        assert sorted(got, key=str) == sorted([(i, value(k, t)) for i, k, t in left], key=str)
    assert out.columns == ["id", "key", "at", "extra", "v"]
    assert [r.v for r in asof.asof_join(frame, steps.limit(0), "key", "at", ["v"]).collect()] == [None] * len(left)
    assert asof.asof_join(frame.limit(0), steps, "key", "at", ["v"]).collect() == []


def test_asof_windows_never_hold_a_whole_key(spark):
    frame = spark.range(10).selectExpr("'a' as key", "timestamp'2024-01-01' + make_dt_interval(int(id)) as at")
    plan = asof.asof_join(frame, frame.withColumn("v", F.lit(1)), "key", "at", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    wide = [line for line in plan.split("\n") if "Window [" in line and "_last" in line]
    assert wide and all("[key#" in line and "_span#" in line.split("], [")[-2 if line.count("], [") > 1 else -1] for line in wide)


def test_scheduled_limits_equal_the_compiled_schedule(spark):
    starts = [("a", START, [(1, 25), (4, 50), (10, 75)]), ("b", START + timedelta(days=3), [(3, 9), (5, 11)]), ("c", None, [(1, 5)]), ("d", START, [])]
    moments = [(s, START + timedelta(days=d, hours=h)) for s, *_ in starts for d in range(-2, 16) for h in (0, 23)]
    got = asof.scheduled_limits(
        spark.createDataFrame(moments, "sender string, at timestamp"),
        spark.createDataFrame([(s, t) for s, t, _ in starts], "sender string, warmup_start timestamp"),
        spark.createDataFrame([(s, d, n) for s, _, e in starts for d, n in e], "sender string, day int, daily_limit int"),
        base=15,
    )
    want = []
    for sender, start, entries in starts:
        rules = G.SendingRules(daily_limit=15, warmup_start=start, warmup_schedule=entries)
        mine = spark.createDataFrame([m for m in moments if m[0] == sender], "sender string, at timestamp")
        want += [tuple(r) for r in mine.select("sender", "at", G.daily_limit(F.col("at"), rules).alias("n")).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
