"""Streaming jobs with timers: several micro-batches, late rows, silent hours, retried batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from driftwise.streaming import stateful as st
from driftwise.streaming import timers as tm
from driftwise.streaming import windows as wn
from tests.conftest import SMALL

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOGIN = "event_id long, user_id long, ip long, ts timestamp, is_failure boolean"
LOG = "event_id long, ts timestamp, is_5xx boolean, latency double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def stream(spark, folder, batches, schema):
    """One file a batch, read in the order they were written."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_login_stream_over_batches_equals_batch_twin(spark, tmp_path):
    """Arrivals out of order within the lateness give the batch twin's counts; rows behind the watermark are dropped and counted."""
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([10, 11]), at(20 * i + rng.randrange(15)), rng.random() < 0.8) for i in range(240)]
    by_arrival = sorted(rows, key=lambda r: r[3] + timedelta(seconds=rng.randrange(300)))
    batches = [by_arrival[i:i + 60] for i in range(0, 240, 60)]
    late = [(900, 1, 10, at(0), True), (901, 2, 10, at(1), False)]
    batches.append([*late, (999, 7, 12, at(100_000), True)])  # the last row lets the watermark pass all others
    src = stream(spark, str(tmp_path / "src"), batches, LOGIN)
    q = tm.run_batches(tm.failure_counts(src, 900 * 1_000_000, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ckpt"), tm.both_scopes)
    got = {r.event_id: (r.user_failures, r.ip_failures) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    users, ips, want = {}, {}, {}
    for i, u, ip, t, failure in sorted(rows, key=lambda r: (r[3], r[0])):
        if not failure:
            users[u] = []
            continue
        users[u] = [x for x in users.get(u, []) if x >= t - timedelta(seconds=900)] + [t]
        ips[ip] = [x for x in ips.get(ip, []) if x >= t - timedelta(seconds=900)] + [t]
        want[i] = (len(users[u]), len(ips[ip]))
    assert got == want
    assert tm.late_rows(q) == 3  # the late failure once a scope, the late success for its user

    known = spark.createDataFrame([r for r in rows if r[1] is not None], LOGIN).withColumns({"t": F.unix_micros("ts"), "ok": ~F.col("is_failure")})
    batch = st.login_guard(known, "event_id", "user_id", "ip", "t", "is_failure", "ok", 900 * 1_000_000).collect()
    assert {r.event_id: r.user_failures for r in batch} == {i: want[i][0] for i, u, _, _, f in rows if f and u is not None}


def hours(pattern):
    """A request an hour; 'x' fails, '.' does not, ' ' is silent."""
    return [(i, at(3600 * i + 60), c == "x", 0.1) for i, c in enumerate(pattern) if c != " "]


def runs_of(spark, tmp_path, pattern, per_batch):
    rows = hours(pattern)
    src = stream(spark, str(tmp_path / "src"), [rows[i:i + per_batch] for i in range(0, len(rows), per_batch)], LOG)
    tm.run_batches(tm.sustained_runs(src, "1 hour", 3, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    hour = lambda us: (us // 1_000_000 - int(START.timestamp())) // 3600
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r.state, hour(r.start_us), hour(r.last_us), r.n_windows, r.fired) for r in rows)


@pytest.mark.parametrize("per_batch", [4, 100])
def test_sustained_breach_is_reset_by_silence(spark, tmp_path, per_batch):
    """Two breaches, a silent hour, two more: never three in a row.  Then three that fire and go on over a cut of batches."""
    got = runs_of(spark, tmp_path, "xx xx.xxxx   .x   .", per_batch)
    assert got == [("firing", 6, 8, 3, True), ("resolved", 0, 1, 2, False), ("resolved", 3, 4, 2, False), ("resolved", 6, 9, 4, True),
                   ("resolved", 14, 14, 1, False)]


@pytest.mark.parametrize("per_batch", [3, 100])
def test_repeat_interval_runs_from_the_last_alert_sent(spark, tmp_path, per_batch):
    """Breaches at hours 4, 5, 9, 10, 11, 16 with six hours: sent at 4 (with 5 and 9), 10 (with 11) and 16."""
    rows = hours("....xx...xxx....x........")
    src = stream(spark, str(tmp_path / "src"), [rows[i:i + per_batch] for i in range(0, len(rows), per_batch)], LOG)
    tm.run_batches(tm.sent_alerts(src, "1 hour", 6, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    start = int(START.timestamp())
    assert sorted(((r.sent_us // 1_000_000 - start) // 3600, r.n_grouped) for r in got) == [(4, 3), (10, 2), (16, 1)]
    log = spark.createDataFrame(rows, LOG)
    batch = wn.alert_dedup(wn.alert_events(wn.error_ratio(log), wn.latency_p95(log)), 6).collect()
    assert sorted((int(r.window_start[11:13]) + 24 * (int(r.window_start[8:10]) - 1), r.n_grouped) for r in batch) == [(4, 3), (10, 2), (16, 1)]
    assert {(r.alertname, r.receiver) for r in batch} == {("High5xxRate", "pagerduty-critical")}


def test_a_retried_scoring_batch_changes_nothing(spark, tmp_path):
    """Arrivals in four batches; a batch run a second time replaces its own rows; anomalies are tagged."""
    from driftwise.catalog.streaming import decide_batch, score_arrivals
    from driftwise.sources.tables import bookings, table

    orders = table(spark, SMALL, "orders")
    src, out = str(tmp_path / "orders"), str(tmp_path / "out")
    orders.repartitionByRange(4, "o_orderkey").write.parquet(src)
    arrivals = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(src)
    score_arrivals(bookings(spark, SMALL, orders=arrivals), out, str(tmp_path / "ckpt"))
    first = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert len(first) == orders.count() and {r[-1] for r in first} == {0, 1, 2, 3}
    again = bookings(spark, SMALL).join(spark.read.parquet(out).where("batch_id = 2").select("booking_id"), "booking_id", "left_semi")
    decide_batch(again, 2, out)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == first
    tagged = {r[3] for r in first}
    assert "" in tagged and "extreme_lead_time" in tagged
