from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from contactmill.streaming import backoff, delivery, runs

START = datetime(2024, 1, 1)


def minutes(n):
    return START + timedelta(minutes=n)


FETCH = "fetch_id long, domain string, fetched_at timestamp, status_code int, bot_page boolean, network_error boolean"


def fetches(spark, *events, domain="s.org"):
    rows = [(i, domain, minutes(m), 403 if what == "403" else 429 if what == "429" else 200 if what in ("ok", "bot") else None, what == "bot", what == "fail") for i, (m, what) in enumerate(events)]
    return spark.createDataFrame(rows, FETCH)


@pytest.mark.parametrize(
    ("events", "states"),
    [
        ([(0, "fail"), (1, "fail"), (2, "ok")], [(False, False)] * 3),
        ([(0, "fail"), (1, "fail"), (2, "fail"), (6, "ok"), (7, "ok")], [(False, False)] * 2 + [(False, True), (False, True), (False, False)]),
        ([(0, "403"), (29, "ok"), (30, "ok")], [(True, False), (True, False), (False, False)]),
        ([(0, "bot"), (10, "429"), (39, "ok"), (41, "ok")], [(True, False)] * 3 + [(False, False)]),
        ([(0, "fail"), (1, "fail"), (2, "ok"), (200, "fail")], [(False, False)] * 3 + [(False, True)]),
        ([(50, "403"), (70, "ok"), (81, "ok")], [(True, False), (True, False), (False, False)]),
    ],
)
def test_backoff_after_each_fetch(spark, events, states):
    rows = backoff.backoff_history(fetches(spark, *events)).orderBy("fetch_id").collect()
    assert [(r.blocked, r.backing_off) for r in rows] == states


def write(df, folder, n):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={n}")


def test_backoff_stream_equals_the_batch_form(spark, tmp_path):
    parts = [
        fetches(spark, (0, "fail"), (1, "fail")).union(fetches(spark, (0, "ok"), domain="t.org")),
        fetches(spark, (9, "fail"), (5, "403")).union(fetches(spark, (3, "bot"), domain="t.org")),
    ]
    for n, part in enumerate(parts):  # two runs on one checkpoint: the state is carried over
        write(part, tmp_path / "in", n)
        stream = delivery.file_stream(spark, FETCH, f"{tmp_path}/in/*")
        out = runs.latest_rows(backoff.domain_state(stream), ["domain"], f"{tmp_path}/run")
    assert "Python" not in backoff.domain_state(parts[0])._jdf.queryExecution().executedPlan().toString()
    seen = {r.domain: tuple(r) for r in out.collect()}
    want = backoff.domain_state(parts[0].union(parts[1])).collect()
    assert seen == {r.domain: tuple(r) for r in want}
    assert seen["s.org"][2] == 3


def test_expiring_state_ends_after_the_block(spark, tmp_path):
    day = 24 * 60
    parts = [
        fetches(spark, (0, "fail"), (1, "fail")).union(fetches(spark, (0, "ok"), domain="t.org")).union(fetches(spark, (5, "403"), domain="u.org")),
        fetches(spark, (3, "fail")).union(fetches(spark, (20, "ok"), domain="t.org")),
        fetches(spark, (3 * day, "ok"), domain="t.org"),
        fetches(spark, (3 * day, "fail")),
    ]
    seen = []
    for n, part in enumerate(parts):
        write(part, tmp_path / "in", n)
        stream = delivery.file_stream(spark, FETCH, f"{tmp_path}/in/*")
        out = runs.latest_rows(backoff.expiring_domain_state(stream), ["domain"], f"{tmp_path}/run")
        seen.append({r.domain: r for r in out.collect()})
    for n in (0, 1):  # before anything expires: the batch form
        batch = parts[0] if n == 0 else parts[0].union(parts[1])
        want = {r.domain: tuple(r) for r in backoff.domain_state(batch).collect()}
        assert {d: tuple(r)[:-1] for d, r in seen[n].items()} == want
        assert not any(r.expired for r in seen[n].values())
    assert seen[1]["s.org"].failures == 3 and seen[1]["s.org"].rests_until
    assert {d: r.expired for d, r in seen[2].items()} == {"s.org": True, "t.org": False, "u.org": True}
    assert (seen[3]["s.org"].failures, seen[3]["s.org"].expired) == (1, False)


def test_latest_status_takes_late_events_and_repeats(spark, tmp_path):
    schema = "ses_message_id string, status string, at timestamp"
    batches = [
        [("a", "sent", minutes(0)), ("b", "opened", minutes(50))],
        [("a", "delivered", minutes(9)), ("b", "delivered", minutes(1)), (None, "sent", minutes(3))],
        [("a", "opened", minutes(5)), ("c", "bounced", minutes(-9999))],
    ]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), tmp_path / "in", n)
        query = delivery.latest_status_stream(
            delivery.file_stream(spark, schema, f"{tmp_path}/in/*"), f"{tmp_path}/status", f"{tmp_path}/cp"
        )
        query.awaitTermination()
    last = delivery.read_latest_status(spark, f"{tmp_path}/status")
    assert {r.ses_message_id: r.status for r in last.collect()} == {"a": "delivered", "b": "opened", "c": "bounced"}
    delivery.compact_latest_status(spark, f"{tmp_path}/status", f"{tmp_path}/compacted")
    assert spark.read.parquet(f"{tmp_path}/compacted").count() == 3
    again = delivery.read_latest_status(spark, f"{tmp_path}/compacted", f"{tmp_path}/status")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, last.collect()))
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(map(tuple, delivery.latest_status(everything).collect())) == sorted((r.ses_message_id, r.status) for r in last.collect())


def test_daily_counter_drops_late_rows_and_shows_the_last_day(spark, tmp_path):
    schema = "status string, sent_at timestamp"
    first = [("sent", minutes(10)), ("delivered", minutes(20)), ("sent", minutes(60 * 26))]
    late = [("sent", minutes(30)), ("sent", minutes(60 * 50))]
    out = None
    for n, rows in enumerate([first, late, [("sent", minutes(60 * 80))]]):
        write(spark.createDataFrame(rows, schema), tmp_path / "in", n)
        stream = delivery.daily_sent(delivery.file_stream(spark, schema, f"{tmp_path}/in/*"))
        out = runs.latest_rows(stream, ["day"], str(tmp_path / "run"))
    got = {r.day.day: (r.sent, r.attempted) for r in out.collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (1, 1)}


def test_rolling_breaker(spark):
    rows = [("sent", minutes(5))] * 18 + [("bounced", minutes(65))] * 2
    df = spark.createDataFrame(rows, "status string, sent_at timestamp")
    got = {r.judged_at: (r.total, r.pause) for r in delivery.rolling_breaker(delivery.hourly_status(df)).collect()}
    assert got[minutes(60)] == (18, False) and got[minutes(120)] == (20, True)
    assert got[minutes(24 * 60)] == (20, True) and got[minutes(25 * 60)] == (2, False)


def test_new_records(spark, tmp_path):
    schema = "source string, source_id string, seen_at timestamp"
    known = spark.createDataFrame([("c", "1")], "source string, source_id string")
    batches = [
        [("a", "1", minutes(0)), ("a", "1", minutes(1)), ("b", "1", minutes(1)), ("c", "1", minutes(2))],
        # A repetition comes out no second time, however late it is.
        [("a", "1", minutes(99_999)), ("a", "2", minutes(9)), ("c", "1", minutes(9))],
    ]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), tmp_path / "in", n)
        stream = delivery.file_stream(spark, schema, f"{tmp_path}/in/*")
        delivery.new_records_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", known).awaitTermination()
    out = spark.read.schema(schema).parquet(f"{tmp_path}/out")
    assert sorted((r.source, r.source_id) for r in out.collect()) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_new_records_read_only_the_buckets_of_a_batch(spark, tmp_path, monkeypatch):
    """Repetitions across runs are told by the key store once the state has forgotten them."""
    schema, scanned = "source string, source_id string", []
    known = spark.createDataFrame([("maps", "k")], schema)
    unseen = delivery.KeyStore.unseen

    def watched(self, rows, batch):
        out = unseen(self, rows, batch)
        scanned.append([line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line and "bucket" in line])
        return out

    monkeypatch.setattr(delivery.KeyStore, "unseen", watched)
    for n in range(6):
        rows = [("maps", f"p{n}"), ("maps", f"p{n - 1}"), ("maps", "p0"), ("maps", "k"), (None, "x"), (None, "x")]
        write(spark.createDataFrame(rows, schema), tmp_path / "in", n)
        stream = delivery.file_stream(spark, schema, f"{tmp_path}/in/*")
        delivery.new_records_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", known, buckets=8, horizon="1 second", fold=2).awaitTermination()
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out").select("source", "source_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "x"), ("maps", "p-1"), *[("maps", f"p{n}") for n in range(6)]], key=repr)
    assert all(any("bucket" in line for line in lines) for lines in scanned if lines) and any(scanned)
    assert max(len(list(p.glob("batch=*"))) for p in (tmp_path / "out/_keys").glob("bucket=*")) <= 4
    assert not list((tmp_path / "out/_incoming").glob("batch=*"))


def test_late_rows_are_kept_aside_and_counted(spark, tmp_path):
    schema = "id int, at timestamp"
    batches = [[(1, minutes(100)), (2, minutes(0))], [(3, minutes(39)), (4, minutes(40)), (5, None)], [], [(6, minutes(300))], [(7, minutes(239)), (8, minutes(100))]]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), tmp_path / "in", n)
        stream = delivery.file_stream(spark, schema, f"{tmp_path}/in/*")
        delivery.split_late_stream(stream, "at", "1 hour", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    split = delivery.read_split(spark, stream.schema, f"{tmp_path}/out")
    assert {r.id: r.late for r in split.collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True}
    report = {r.batch: (r["rows"], r.late, r.worst_ms) for r in delivery.late_report(split, "at").collect()}
    last = max(report)
    assert report[0] == (2, 0, None) and report[1] == (3, 2, 61 * 60_000) and report[last] == (2, 2, 200 * 60_000)
    plan = split.where("late")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(late" in plan


def test_sliding_breaker_streams_in_one_plan(spark, tmp_path):
    sends = [("sent", minutes(0)), ("bounced", minutes(50)), ("delivered", minutes(61)), ("sent", minutes(60 * 30)), ("sent", None)]
    rows = spark.createDataFrame(sends, "status string, sent_at timestamp")
    want = delivery.rolling_breaker(delivery.hourly_status(rows.where("sent_at is not null")))
    write(rows, tmp_path / "in", 0)
    stream = delivery.sliding_breaker(delivery.file_stream(spark, rows.schema, f"{tmp_path}/in/*"))
    got = runs.latest_rows(stream, ["judged_at"], f"{tmp_path}/run")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, delivery.sliding_breaker(rows).collect())) == sorted(map(tuple, want.collect()))
