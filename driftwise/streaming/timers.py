"""Streaming jobs with event-time timers: login guard (R3), sustained breach (R10), alert repeat interval.

Each job is a ``transformWithState`` processor over a keyed stream.  Rows wait in state until the watermark has passed
them, so the result does not depend on how arrivals are cut into micro-batches; rows behind the watermark are dropped by
Spark and counted in the query's progress (``late_rows``).  State with a TTL exists in processing time only, so these
processors evict by event time themselves.  A key is one sequential unit: its state holds the rows of one window
and of the allowed lateness, never its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from driftwise.streaming import windows as wn

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Timers and list state need the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE_CONF, None)
    spark.conf.set(STORE_CONF, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(STORE_CONF, before) if before else spark.conf.unset(STORE_CONF)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators dropped behind the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def run_batches(out: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    """Run ``out`` over what its source holds now; every micro-batch, shaped, replaces its own partition of ``path``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        wn.write_batch(shape(batch), batch_id, path)

    with timer_store(out.sparkSession):
        q = out.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def _row(state) -> tuple | None:
    return tuple(state.get()) if state.exists() else None


class FailureWindow(StatefulProcessor):
    """R3 per scope and key: failures of the trailing window since the last success, in event order."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "t long, id long, failure boolean")
        self.stamps = handle.getListState("stamps", "t long")
        self.next = handle.getValueState("next", "ms long")

    def _wake(self, t_us: int | None) -> None:
        """One timer a key, at its earliest waiting row."""
        ms = None if t_us is None else -(-t_us // 1000)
        old = _row(self.next)
        if old and old[0] != ms:
            self.handle.deleteTimer(old[0])
        if ms is None:
            self.next.clear()
        elif not old or old[0] != ms:
            self.handle.registerTimer(ms)
            self.next.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        new = [(r.t_us, r.event_id, r.is_failure) for r in rows]
        self.pending.appendList(new)
        first, old = min(new)[0], _row(self.next)
        if not old or -(-first // 1000) < old[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.pending.get())
        due = [r for r in waiting if r[0] <= until]
        stamps, head = [r[0] for r in self.stamps.get()], 0
        for t, event_id, failure in due:
            if not failure:
                stamps, head = [], 0
                continue
            stamps.append(t)
            while stamps[head] < t - self.window_us:
                head += 1
            yield Row(event_id=event_id, scope=key[0], failures=len(stamps) - head)
        kept, rest = stamps[head:], waiting[len(due):]
        self.stamps.put([(t,) for t in kept]) if kept else self.stamps.clear()
        self.pending.put(rest) if rest else self.pending.clear()
        self.next.clear()  # the timer that has fired is gone
        self._wake(rest[0][0] if rest else None)

    def close(self) -> None:
        pass


def failure_counts(events: DataFrame, window_us: int, delay: str) -> DataFrame:
    """Stream of ``(event_id, scope, failures)`` from ``(event_id, user_id, ip, ts, is_failure)``.

    A success (``is_failure`` false) clears its user's failures and none of the address.  Rows without time are left out;
    a null user or address is a key like any other.
    """
    scopes = F.array(F.struct(F.lit("user").alias("scope"), F.col("user_id").cast("string").alias("who")),
                     F.struct(F.lit("ip").alias("scope"), F.col("ip").cast("string").alias("who")))
    rows = events.where("ts IS NOT NULL").withWatermark("ts", delay).withColumn("s", F.explode(scopes))
    rows = rows.select("s.*", "event_id", "ts", F.unix_micros("ts").alias("t_us"), "is_failure")
    keyed = rows.where(F.col("is_failure") | (F.col("scope") == "user")).groupBy("scope", "who")
    return keyed.transformWithState(FailureWindow(window_us), "event_id long, scope string, failures long", "Append", "EventTime")


def both_scopes(counts: DataFrame) -> DataFrame:
    """``(event_id, user_failures, ip_failures)``: both scopes of an event pass the watermark in the same micro-batch."""
    of = {s: F.max(F.when(F.col("scope") == s, F.col("failures"))).alias(f"{s}_failures") for s in ("user", "ip")}
    return counts.groupBy("event_id").agg(*of.values())


class Sustained(StatefulProcessor):
    """R10 per alert: ``firing`` at the window that completes ``need`` breaches in a row, ``resolved`` when the run ends.

    A run ends at a window without breach or, by the timer, at a silent one.
    """

    def __init__(self, step_us: int, need: int):
        self.step_us, self.need = step_us, need

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, last long, n long")

    def _ends(self, last: int) -> int:
        return (last + 2 * self.step_us) // 1000

    def _row(self, key, state: str, run: tuple) -> Row:
        return Row(alertname=key[0], state=state, start_us=run[0], last_us=run[1], n_windows=run[2], fired=run[2] >= self.need)

    def handleInputRows(self, key, rows, timerValues):
        before = run = _row(self.run)
        for start, breach in sorted((r.start_us, r.breach) for r in rows):
            if run and (not breach or start != run[1] + self.step_us):
                yield self._row(key, "resolved", run)
                run = None
            if breach:
                run = (run[0] if run else start, start, run[2] + 1 if run else 1)
                if run[2] == self.need:
                    yield self._row(key, "firing", run)
        if before:
            self.handle.deleteTimer(self._ends(before[1]))
        if run:
            self.run.update(run)
            self.handle.registerTimer(self._ends(run[1]))
        elif before:
            self.run.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        run = _row(self.run)
        if run and self._ends(run[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key, "resolved", run)
            self.run.clear()

    def close(self) -> None:
        pass


class RepeatInterval(StatefulProcessor):
    """R14 per (alertname, service): an alert goes out when none has gone out within the repeat interval before it; the
    others are grouped with the last one sent.  The group is emitted once the interval is over."""

    def __init__(self, repeat_us: int):
        self.repeat_us = repeat_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sent long, n long, severity string")

    def _row(self, key, group: tuple) -> Row:
        return Row(alertname=key[0], service=key[1], severity=group[2], sent_us=group[0], n_grouped=group[1])

    def handleInputRows(self, key, rows, timerValues):
        before = group = _row(self.open)
        for at, severity in sorted((r.start_us, r.severity) for r in rows):
            if group and at < group[0] + self.repeat_us:
                group = (group[0], group[1] + 1, group[2])
                continue
            if group:
                yield self._row(key, group)
            group = (at, 1, severity)
        if before and before[0] != group[0]:
            self.handle.deleteTimer(self._over(before))
        if not before or before[0] != group[0]:
            self.handle.registerTimer(self._over(group))
        self.open.update(group)

    def _over(self, group: tuple) -> int:
        return (group[0] + self.repeat_us) // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        group = _row(self.open)
        if group and self._over(group) <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key, group)
            self.open.clear()

    def close(self) -> None:
        pass


def breach_windows(log: DataFrame, size: str, delay: str) -> DataFrame:
    """Stream of closed windows: ``(ts, start_us, high_5xx, high_p95)``, both conditions from one aggregation."""
    secs = float(wn._seconds(size))
    n = f"le_{len(wn.LATENCY_BUCKETS)}"
    agg = log.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w")).agg(
        F.count_if("is_5xx").alias("n_5xx"), *wn.bucket_counts_expr(F.col("latency")))
    return agg.select(F.window_time("w").alias("ts"), F.unix_micros("w.start").alias("start_us"),
                      (wn.ratio_of(F.col("n_5xx"), F.col(n), secs) > F.lit(wn.ERROR_BUDGET)).alias("high_5xx"),
                      F.coalesce(wn.histogram_quantile(0.95, n) > F.lit(wn.P95_SLO_SECONDS), F.lit(False)).alias("high_p95"))


def sustained_runs(log: DataFrame, size: str, need: int, delay: str) -> DataFrame:
    """R10 of the 5xx breach over a request log: ``(alertname, state, start_us, last_us, n_windows, fired)``."""
    flags = breach_windows(log, size, delay).select(F.lit("High5xxRate").alias("alertname"), "ts", "start_us", F.col("high_5xx").alias("breach"))
    return flags.groupBy("alertname").transformWithState(
        Sustained(wn._seconds(size) * 1_000_000, need),
        "alertname string, state string, start_us long, last_us long, n_windows long, fired boolean", "Append", "EventTime")


def sent_alerts(log: DataFrame, size: str, repeat_hours: int, delay: str) -> DataFrame:
    """R14 of the 5xx and p95 alerts over a request log: ``(alertname, service, severity, sent_us, n_grouped)``."""
    kinds = F.array(*[F.when(F.col(flag), F.struct(F.lit(name).alias("alertname"), F.lit(severity).alias("severity")))
                      for flag, name, severity in (("high_5xx", "High5xxRate", "critical"), ("high_p95", "HighP95Latency", "warning"))])
    alerts = breach_windows(log, size, delay).select("ts", "start_us", F.explode(F.array_compact(kinds)).alias("a"))
    keyed = alerts.select("ts", "start_us", "a.*", F.lit(wn.SERVICE).alias("service")).groupBy("alertname", "service")
    return keyed.transformWithState(RepeatInterval(repeat_hours * 3600 * 1_000_000),
                                    "alertname string, service string, severity string, sent_us long, n_grouped long", "Append", "EventTime")
