"""Event-time window jobs (R4–R14, R16) written once and run as batch or as Structured Streaming.

Every builder takes a DataFrame of events with an event-time column ``ts``
(TIMESTAMP) and returns the aggregated frame, so the same function backs the
batch twin (what the SQL oracle checks) and the streaming job (``readStream``
on the event files, watermark, ``foreachBatch`` upsert sink).

Fixed values of the reference kept here: the 13 latency buckets (seconds), the
error-budget burn factors (14.4× fast, 6× slow) against a 0.1 % budget, the 5xx
threshold 0.1 %, the p95 SLO 0.3 s, the action-rate deviation 0.15 over 7 days.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latency histogram buckets of the reference (seconds), then +Inf.
LATENCY_BUCKETS = (0.001, 0.005, 0.010, 0.025, 0.050, 0.100, 0.250, 0.500, 1.0, 2.5, 5.0, 10.0, 30.0)
ERROR_BUDGET = 0.001
SPIKE_PER_SECOND = 0.2
FAST_BURN = 14.4
SLOW_BURN = 6.0
P95_SLO_SECONDS = 0.3
RATIO_FLOOR = 0.001
ACTION_RATE_DEVIATION = 0.15
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
SERVICE = "analytics-api"
# Alert receivers by severity.
RECEIVERS = (("critical", "pagerduty-critical"), ("warning", "slack-warnings"))
DEFAULT_RECEIVER = "default-receiver"


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Parquet timestamps without zone load as TIMESTAMP_NTZ; windows and watermarks need TIMESTAMP (UTC session)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def fmt(c: Column) -> Column:
    return F.date_format(c, TS_FORMAT)


def request_log(events: DataFrame) -> DataFrame:
    """Proxy request log: status 5xx for error events, latency = value / 100 seconds, success otherwise."""
    return events.select(
        "event_id", "ts", "user_id", "event_type",
        (F.col("event_type") == "error").alias("is_5xx"),
        (F.col("value") / F.lit(100.0)).alias("latency"),
    )


def window_rates(log: DataFrame, size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Request counts and per-second rates by event type on sliding windows."""
    w = F.window("ts", size, slide)
    secs = _seconds(size)
    return log.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_requests")).select(
        fmt(F.col("w.start")).alias("window_start"), "event_type", "n_requests",
        (F.col("n_requests") / F.lit(float(secs))).alias("rate_per_sec"),
    )


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "day": 86400, "days": 86400}[unit]
    return int(n) * mult


def bucket_counts_expr(latency: Column) -> list[Column]:
    """Cumulative bucket counters (le = each bound, then +Inf) as Prometheus keeps them."""
    return [F.count_if(latency <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(LATENCY_BUCKETS)] + [
        F.count(F.lit(1)).alias(f"le_{len(LATENCY_BUCKETS)}")
    ]


def histogram_quantile(q: float, n_col: str = "n") -> Column:
    """Prometheus histogram_quantile — linear interpolation inside the bucket holding rank q·n.

    Rank beyond the last finite bucket returns that bucket's upper bound; an
    empty window returns NULL.
    """
    bounds = [0.0, *LATENCY_BUCKETS]
    rank = F.lit(float(q)) * F.col(n_col)
    expr = F.lit(float(LATENCY_BUCKETS[-1]))
    # walk buckets from the last to the first so the first bucket whose count reaches the rank wins
    for i in reversed(range(len(LATENCY_BUCKETS))):
        lo_count = F.col(f"le_{i - 1}") if i > 0 else F.lit(0)
        hi_count = F.col(f"le_{i}")
        lo, hi = bounds[i], bounds[i + 1]
        frac = F.try_divide(rank - lo_count, (hi_count - lo_count).cast("double"))
        val = F.lit(lo) + F.lit(hi - lo) * F.coalesce(frac, F.lit(0.0))
        expr = F.when(hi_count >= rank, val).otherwise(expr)
    return F.when(F.col(n_col) > 0, expr)


def latency_p95(log: DataFrame, size: str = "1 hour") -> DataFrame:
    """Per tumbling window, the bucketed p95 (interpolated) and the exact p95 (twin), count, SLO flag."""
    w = F.window("ts", size)
    agg = log.groupBy(w.alias("w")).agg(
        *bucket_counts_expr(F.col("latency")), F.percentile(F.col("latency"), 0.95).alias("p95_exact")
    ).withColumn("n", F.col(f"le_{len(LATENCY_BUCKETS)}"))
    return agg.select(
        fmt(F.col("w.start")).alias("window_start"), F.col("n").cast("long").alias("n_requests"),
        histogram_quantile(0.95).alias("p95_hist"), "p95_exact", (histogram_quantile(0.95) > F.lit(P95_SLO_SECONDS)).alias("slo_breach"),
    )


def ratio_of(errors: Column, requests: Column, secs: float) -> Column:
    """errors per request, the request rate not below the floor."""
    return (errors / F.lit(secs)) / F.greatest(requests / F.lit(secs), F.lit(RATIO_FLOOR))


def error_ratio(log: DataFrame, size: str = "1 hour") -> DataFrame:
    """5xx ratio per window with the 0.001/s denominator floor; breach above 0.1 %; error rate/s."""
    secs = float(_seconds(size))
    w = F.window("ts", size)
    agg = log.groupBy(w.alias("w")).agg(F.count_if("is_5xx").alias("n_5xx"), F.count(F.lit(1)).alias("n_requests"))
    ratio = ratio_of(F.col("n_5xx"), F.col("n_requests"), secs)
    return agg.select(
        fmt(F.col("w.start")).alias("window_start"), "n_5xx", "n_requests", ratio.alias("error_ratio"),
        (ratio > F.lit(ERROR_BUDGET)).alias("breach"), (F.col("n_5xx") / F.lit(secs)).alias("error_rate_per_sec"),
    )


def error_spike(log: DataFrame, size: str = "5 minutes", limit: float = SPIKE_PER_SECOND) -> DataFrame:
    """Errors per window and second; a spike above ``limit``."""
    agg = log.groupBy(F.window("ts", size).alias("w")).agg(F.count_if("is_5xx").alias("n_errors"))
    rate = F.col("n_errors") / F.lit(float(_seconds(size)))
    return agg.select(fmt(F.col("w.start")).alias("window_start"), "n_errors", rate.alias("errors_per_sec"), (rate > F.lit(limit)).alias("spike"))


def burn_rate(log: DataFrame, fast: str = "1 hour", slow: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    """Fast (14.4×) and slow (6×) error-budget burn on two sliding windows joined on their end."""

    def ratios(size: str) -> DataFrame:
        secs = float(_seconds(size))
        w = F.window("ts", size, slide)
        a = log.groupBy(w.alias("w")).agg(F.count_if("is_5xx").alias("e"), F.count(F.lit(1)).alias("n"))
        return a.select(F.col("w.end").alias("window_end"), ratio_of(F.col("e"), F.col("n"), secs).alias("r"))

    f = ratios(fast).withColumnRenamed("r", "fast_ratio")
    s = ratios(slow).withColumnRenamed("r", "slow_ratio")
    j = f.join(s, "window_end", "full_outer")
    return j.select(
        fmt(F.col("window_end")).alias("window_end"), "fast_ratio", "slow_ratio",
        F.coalesce(F.col("fast_ratio") > F.lit(FAST_BURN * ERROR_BUDGET), F.lit(False)).alias("fast_burn"),
        F.coalesce(F.col("slow_ratio") > F.lit(SLOW_BURN * ERROR_BUDGET), F.lit(False)).alias("slow_burn"),
    )


def window_spine(spark: SparkSession, start: Column, end: Column, step_seconds: int, bounds: DataFrame) -> DataFrame:
    """All window starts between the first and the last event (the spine is O(time span / step), not O(rows))."""
    return bounds.select(F.explode(F.sequence(start, end, F.expr(f"INTERVAL {step_seconds} SECONDS"))).alias("window_start_ts"))


def sustained(flags: DataFrame, ts_col: str, flag_col: str, step_seconds: int, min_windows: int) -> DataFrame:
    """R10 ("for: N"): islands of consecutive windows where the condition holds; fired when ≥ ``min_windows``.

    Windows without events are on the spine and break an island.  Islands are
    found by the gaps-and-islands difference of row numbers over the spine,
    whose length is bounded by the time span divided by the step.
    """
    spark = flags.sparkSession
    bounds = flags.agg(F.min(ts_col).alias("a"), F.max(ts_col).alias("b"))
    spine = window_spine(spark, F.col("a"), F.col("b"), step_seconds, bounds)
    full = spine.join(flags.select(F.col(ts_col).alias("window_start_ts"), flag_col), "window_start_ts", "left").fillna(False, [flag_col])
    from pyspark.sql import Window

    w_all = Window.orderBy("window_start_ts")  # spine rows only
    w_flag = Window.partitionBy(flag_col).orderBy("window_start_ts")
    isl = full.withColumn("_g", F.row_number().over(w_all) - F.row_number().over(w_flag)).where(F.col(flag_col))
    return isl.groupBy("_g").agg(
        F.min("window_start_ts").alias("island_start"), F.max("window_start_ts").alias("island_last"), F.count(F.lit(1)).alias("n_windows")
    ).select(fmt(F.col("island_start")).alias("island_start"), fmt(F.col("island_last")).alias("island_last"), "n_windows",
             (F.col("n_windows") >= F.lit(min_windows)).alias("fired"))


def session_windows(events: DataFrame, key: str, gap: str = "12 hours") -> DataFrame:
    """Activity sessions per key (idle gap closes a session): count, first and last activity, expiry."""
    s = F.session_window("ts", gap)
    return events.groupBy(key, s.alias("s")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).select(key, fmt(F.col("first_ts")).alias("created"), fmt(F.col("last_ts")).alias("last_active"),
             fmt(F.col("s.end")).alias("expires_at"), "n_events")


def daily_rate(events: DataFrame, is_action: Column) -> DataFrame:
    """Daily action rate (actions / events per day)."""
    d = events.select(F.to_date("ts").alias("day"), is_action.alias("a"))
    return d.groupBy("day").agg(F.avg(F.col("a").cast("double")).alias("action_rate"), F.count(F.lit(1)).alias("n"))


def action_rate_vs_7d(events: DataFrame, is_action: Column) -> DataFrame:
    """|daily action rate − mean of the last 7 daily rates (incl. today)| > 0.15.

    One row per day: the range window runs over the day series (bounded by the
    time span), not over events.
    """
    from pyspark.sql import Window

    d = daily_rate(events, is_action).withColumn("day_n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.orderBy("day_n").rangeBetween(-6, 0)
    avg7 = F.avg("action_rate").over(w)
    return d.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "action_rate", avg7.alias("avg_7d"),
        (F.abs(F.col("action_rate") - avg7) > F.lit(ACTION_RATE_DEVIATION)).alias("anomaly"),
    )


def alert_events(error_windows: DataFrame, p95_windows: DataFrame) -> DataFrame:
    """Alert instances per window from the 5xx and p95 conditions (alertname, severity, service, ts)."""
    svc = F.lit(SERVICE)
    a = error_windows.where("breach").select(F.lit("High5xxRate").alias("alertname"), F.lit("critical").alias("severity"), svc.alias("service"), "window_start")
    b = p95_windows.where("slo_breach").select(F.lit("HighP95Latency").alias("alertname"), F.lit("warning").alias("severity"), svc.alias("service"), "window_start")
    return a.unionByName(b)


def alert_dedup(alerts: DataFrame, repeat_hours: int = 1) -> DataFrame:
    """Per (alertname, service) an alert goes out unless one went out less than the repeat interval before; later ones
    are grouped with it; route by severity.

    The fold runs over the window starts of one alert, at most one per window of the time span, not over events.
    """
    at = F.unix_seconds(F.to_timestamp("window_start", TS_FORMAT))
    one = F.struct(at.alias("at"), F.col("severity").alias("severity"))
    keyed = alerts.groupBy("alertname", "service").agg(F.array_sort(F.collect_list(one)).alias("all"))
    group = "array<struct<sent:bigint,severity:string,n_grouped:bigint>>"
    step = f"""aggregate(all, CAST(array() AS {group}), (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.at < element_at(acc, -1).sent + {3600 * repeat_hours}
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('sent', element_at(acc, -1).sent,
                         'severity', element_at(acc, -1).severity, 'n_grouped', element_at(acc, -1).n_grouped + 1L)))
             ELSE concat(acc, array(named_struct('sent', x.at, 'severity', x.severity, 'n_grouped', 1L))) END)"""
    sent = keyed.select("alertname", "service", F.explode(F.expr(step)).alias("g")).select("alertname", "service", "g.*")
    return sent.select("alertname", "service", "severity", fmt(F.timestamp_seconds("sent")).alias("window_start"), "n_grouped", receiver().alias("receiver"))


def receiver() -> Column:
    """Receiver of an alert by its severity."""
    route = F.lit(DEFAULT_RECEIVER)
    for severity, name in RECEIVERS:
        route = F.when(F.col("severity") == severity, F.lit(name)).otherwise(route)
    return route


# ---------------------------------------------------------------- streaming runner


def event_stream(
    spark: SparkSession, folder: str, schema: T.StructType, file_glob: str | None = None, max_files_per_trigger: int | None = None
) -> DataFrame:
    """``readStream`` over the Parquet files of a folder (optionally filtered by a file-name glob), event time as TIMESTAMP."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return event_time(r.parquet(folder))


def write_batch(batch: DataFrame, batch_id: int, path: str, column: str = "batch_id") -> None:
    """Sink step that a retry repeats without effect: a micro-batch replaces its own partition of the table."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{column}={batch_id}")


def run_to_table(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], keys: Sequence[str], out_path: str, checkpoint: str,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Run ``build`` on a stream with a watermark; each micro-batch's updated rows replace the partition of their
    batch id (``foreachBatch``), and the table view keeps the newest version of every key (idempotent upsert: a
    retried batch rewrites its partition).  Returns the latest-version view."""
    agg = build(stream.withWatermark("ts", watermark))

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, out_path, "_batch")

    q = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    out = spark.read.parquet(out_path)
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_batch")
