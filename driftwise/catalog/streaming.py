"""Named queries for the windowed and stateful event jobs (step 11) on ``events``.

Proxies: a request is an event; status 5xx = ``event_type = 'error'``; latency
= ``value / 100`` seconds; an action = ``purchase``; login failure / success =
``error`` / ``signup`` per ``user_id``, with the ``k`` field of ``props`` as the
client address.  Window sizes are scaled to the test data's event rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.catalog.decision import _DECIDE_CTES as DECIDE_CTES
from driftwise.catalog.decision import FLAGSHIP_POLICY
from driftwise.catalog.drift import _CAT_PSI_CTES, DRIFT_COLS
from driftwise.catalog.sqlgen import binned_counts_ctes, divergence_select, long_union
from driftwise.functions.scalar import rnd
from driftwise.operators.anomaly import tag_row_anomalies
from driftwise.operators.policy import score_and_decide
from driftwise.sources.files import scratch_path
from driftwise.sources.tables import bookings, table
from driftwise.streaming import stateful as st
from driftwise.streaming import timers as tm
from driftwise.streaming import windows as wn

THROTTLE_LIMIT = 2
THROTTLE_WINDOW_US = 3600 * 1_000_000
LOGIN_WINDOW_US = 7 * 86400 * 1_000_000
SUSTAIN_WINDOWS = 3
DEDUP_HOURS = 6
LATENESS = "10 minutes"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.event_time(table(spark, sf_dir, "events"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.request_log(_events(spark, sf_dir))


_TS = "CAST(ts AS TIMESTAMP)"
_FMT = "strftime({x}, '%Y-%m-%d %H:%M:%S')"
_RATES_SQL = f"""WITH l AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', {_TS}) AS b FROM events),
w AS (SELECT event_type, b AS ws FROM l UNION ALL SELECT event_type, b - INTERVAL '30 minutes' FROM l)
SELECT {_FMT.format(x='ws')} AS window_start, event_type, count(*) AS n_requests, round(count(*) / 3600.0, 6) AS rate_per_sec
FROM w GROUP BY ALL"""


@register("window_rates", _RATES_SQL)
def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request counts and per-second rates by event type on 1-hour windows sliding by 30 minutes."""
    out = wn.window_rates(_log(spark, sf_dir))
    return out.select("window_start", "event_type", "n_requests", rnd(F.col("rate_per_sec")).alias("rate_per_sec"))


@register("window_rates_stream", _RATES_SQL)
def window_rates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 as Structured Streaming: readStream over the events files, 10-minute watermark, update mode into a
    foreachBatch upsert sink in the shared checkpoint folder (availableNow), newest version per window."""
    schema = table(spark, sf_dir, "events").schema
    stream = wn.event_stream(spark, sf_dir, schema, file_glob="events.parquet")
    out_path = scratch_path(spark, "stream-window-rates")
    ckpt = scratch_path(spark, "stream-window-rates-ckpt")
    res = wn.run_to_table(stream.transform(wn.request_log), wn.window_rates, ["window_start", "event_type"], out_path, ckpt)
    return res.select("window_start", "event_type", "n_requests", rnd(F.col("rate_per_sec")).alias("rate_per_sec"))


def _hist_sql() -> str:
    b = wn.LATENCY_BUCKETS
    les = ", ".join(f"count_if(latency <= {v!r}) AS le_{i}" for i, v in enumerate(b)) + f", count(*) AS le_{len(b)}"
    bounds = [0.0, *b]
    expr = repr(float(b[-1]))
    for i in reversed(range(len(b))):
        lo_c = f"le_{i - 1}" if i > 0 else "0"
        frac = f"coalesce((0.95 * le_{len(b)} - {lo_c}) / nullif(CAST(le_{i} - {lo_c} AS DOUBLE), 0), 0.0)"
        val = f"({bounds[i]!r} + {bounds[i + 1] - bounds[i]!r} * {frac})"
        expr = f"CASE WHEN le_{i} >= 0.95 * le_{len(b)} THEN {val} ELSE {expr} END"
    return f"""WITH l AS (SELECT time_bucket(INTERVAL '1 hour', {_TS}) AS ws, value / 100.0 AS latency FROM events),
h AS (SELECT ws, {les}, quantile_cont(latency, 0.95) AS p95_exact FROM l GROUP BY ws),
q AS (SELECT ws, le_{len(b)} AS n_requests, CASE WHEN le_{len(b)} > 0 THEN {expr} END AS p95_hist, p95_exact FROM h)
SELECT {_FMT.format(x='ws')} AS window_start, n_requests, round(p95_hist, 6) AS p95_hist, round(p95_exact, 6) AS p95_exact,
       p95_hist > {wn.P95_SLO_SECONDS} AS slo_breach FROM q"""


@register("p95_histogram", _hist_sql())
def p95_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly latency histogram on the 13 reference buckets → interpolated p95, with the exact p95 twin."""
    out = wn.latency_p95(_log(spark, sf_dir))
    return out.select("window_start", "n_requests", rnd(F.col("p95_hist")).alias("p95_hist"), rnd(F.col("p95_exact")).alias("p95_exact"), "slo_breach")


_ERR_CTE = f"""er AS (SELECT time_bucket(INTERVAL '1 hour', {_TS}) AS ws, count_if(event_type = 'error') AS n_5xx, count(*) AS n_requests
            FROM events GROUP BY 1),
er2 AS (SELECT *, (n_5xx / 3600.0) / greatest(n_requests / 3600.0, 0.001) AS error_ratio FROM er)"""


@register(
    "error_ratio",
    f"""WITH {_ERR_CTE}
SELECT {_FMT.format(x='ws')} AS window_start, n_5xx, n_requests, round(error_ratio, 6) AS error_ratio, error_ratio > 0.001 AS breach,
       round(n_5xx / 3600.0, 6) AS error_rate_per_sec FROM er2""",
)
def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly 5xx ratio with the 0.001/s denominator floor, 0.1 % breach flag, error rate per second."""
    out = wn.error_ratio(_log(spark, sf_dir))
    return out.select("window_start", "n_5xx", "n_requests", rnd(F.col("error_ratio")).alias("error_ratio"), "breach",
                      rnd(F.col("error_rate_per_sec")).alias("error_rate_per_sec"))


@register(
    "error_spike",
    f"""SELECT {_FMT.format(x='ws')} AS window_start, n_errors, round(n_errors / 300.0, 6) AS errors_per_sec,
       n_errors / 300.0 > {wn.SPIKE_PER_SECOND} AS spike
FROM (SELECT time_bucket(INTERVAL '5 minutes', {_TS}) AS ws, count_if(event_type = 'error') AS n_errors FROM events GROUP BY 1) w""",
)
def error_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per second on 5-minute windows; a spike above 0.2 per second."""
    out = wn.error_spike(_log(spark, sf_dir))
    return out.select("window_start", "n_errors", rnd(F.col("errors_per_sec")).alias("errors_per_sec"), "spike")


@register(
    "burn_rate",
    f"""WITH b AS (SELECT time_bucket(INTERVAL '1 hour', {_TS}) AS hb, event_type = 'error' AS e FROM events),
f AS (SELECT hb + INTERVAL '1 hour' AS we, (count_if(e) / 3600.0) / greatest(count(*) / 3600.0, 0.001) AS fast_ratio FROM b GROUP BY hb),
s0 AS (SELECT hb + INTERVAL (o + 1) HOUR AS we, e FROM b, (SELECT unnest(range(0, 6)) AS o)),
s AS (SELECT we, (count_if(e) / 21600.0) / greatest(count(*) / 21600.0, 0.001) AS slow_ratio FROM s0 GROUP BY we)
SELECT {_FMT.format(x='coalesce(f.we, s.we)')} AS window_end, round(fast_ratio, 6) AS fast_ratio, round(slow_ratio, 6) AS slow_ratio,
       coalesce(fast_ratio > 14.4 * 0.001, false) AS fast_burn, coalesce(slow_ratio > 6.0 * 0.001, false) AS slow_burn
FROM f FULL OUTER JOIN s ON f.we = s.we""",
)
def burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-budget burn — fast (1 h, > 14.4×0.1 %) and slow (6 h sliding by 1 h, > 6×0.1 %) joined on window end."""
    out = wn.burn_rate(_log(spark, sf_dir))
    return out.select("window_end", rnd(F.col("fast_ratio")).alias("fast_ratio"), rnd(F.col("slow_ratio")).alias("slow_ratio"), "fast_burn", "slow_burn")


@register(
    "sustained_alert",
    f"""WITH {_ERR_CTE},
sp AS (SELECT unnest(range((SELECT min(ws) FROM er2), (SELECT max(ws) FROM er2) + INTERVAL '1 second', INTERVAL '1 hour')) AS ws),
fl AS (SELECT sp.ws, coalesce(er2.error_ratio > 0.001, false) AS flag FROM sp LEFT JOIN er2 USING (ws)),
g AS (SELECT ws, flag, row_number() OVER (ORDER BY ws) - row_number() OVER (PARTITION BY flag ORDER BY ws) AS grp FROM fl)
SELECT {_FMT.format(x='min(ws)')} AS island_start, {_FMT.format(x='max(ws)')} AS island_last, count(*) AS n_windows,
       count(*) >= {SUSTAIN_WINDOWS} AS fired
FROM g WHERE flag GROUP BY grp""",
)
def sustained_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive hourly windows with a 5xx breach (empty hours break a run); fired at ≥ 3 windows."""
    er = wn.error_ratio(_log(spark, sf_dir)).select(F.to_timestamp("window_start", wn.TS_FORMAT).alias("ws"), "breach")
    return wn.sustained(er, "ws", "breach", 3600, SUSTAIN_WINDOWS)


# From the rule text: min(roc_auc) < 0.65 or max(feature_psi) > 0.2.
_GAUGES_SQL = (
    binned_counts_ctes(long_union(DRIFT_COLS)) + "," + divergence_select("psi") + "," + _CAT_PSI_CTES + """,
ob AS (SELECT score AS p, y FROM bookings WHERE period = 'cur'),
og AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ob GROUP BY p),
oc AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM og),
mq AS (SELECT (SELECT sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) FROM oc) < 0.65 AS auc_low,
              (SELECT max(v) FROM (SELECT score AS v FROM scores UNION ALL SELECT psi FROM cpsi)) > 0.2 AS psi_high)"""
)


@register(
    "correlated_alert",
    with_bookings(
        f"""
SELECT {_FMT.format(x='e.ws')} AS window_start, e.error_ratio > 0.001 AS high_5xx, p.p95_hist > {wn.P95_SLO_SECONDS} AS high_p95,
       mq.auc_low, mq.psi_high, (e.error_ratio > 0.001) AND (p.p95_hist > {wn.P95_SLO_SECONDS}) AND (mq.auc_low OR mq.psi_high) AS correlated
FROM er2 e JOIN ph p ON p.ws = e.ws CROSS JOIN mq""",
        _ERR_CTE
        + ","
        + _hist_sql().split("WITH ", 1)[1].split("\nSELECT")[0].replace("q AS (", "ph AS (")
        + ","
        + _GAUGES_SQL,
    ),
)
def correlated_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour, 5xx breach AND p95 breach AND (AUC of the current period < 0.65 OR largest feature PSI > 0.2); the two
    gauges of the monitoring table join every window as literals."""
    from driftwise.catalog.ops import model_health

    gauges = model_health(spark, sf_dir).groupBy((F.col("signal") == "roc_auc").alias("is_auc")).agg(F.max("breached").alias("b")).collect()
    state = {r["is_auc"]: bool(r["b"]) for r in gauges}
    return correlated(_log(spark, sf_dir), state.get(True, False), state.get(False, False))


def correlated(log: DataFrame, auc_low: bool, psi_high: bool) -> DataFrame:
    """R11 for the hours of a request log and the state of the two model gauges."""
    er = wn.error_ratio(log).select("window_start", (F.col("error_ratio") > F.lit(wn.ERROR_BUDGET)).alias("high_5xx"))
    ph = wn.latency_p95(log).select("window_start", (F.col("p95_hist") > F.lit(wn.P95_SLO_SECONDS)).alias("high_p95"))
    j = er.join(ph, "window_start").withColumns({"auc_low": F.lit(auc_low), "psi_high": F.lit(psi_high)})
    return j.withColumn("correlated", F.col("high_5xx") & F.col("high_p95") & (F.col("auc_low") | F.col("psi_high")))


@register(
    "action_rate_7d",
    f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS action_rate
           FROM events GROUP BY 1),
a AS (SELECT *, avg(action_rate) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS avg_7d FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, n, round(action_rate, 6) AS action_rate, round(avg_7d, 6) AS avg_7d,
       abs(action_rate - avg_7d) > {wn.ACTION_RATE_DEVIATION} AS anomaly FROM a""",
)
def action_rate_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily action (purchase) rate vs its trailing 7-day mean; anomaly when the gap exceeds 0.15."""
    out = wn.action_rate_vs_7d(_events(spark, sf_dir), F.col("event_type") == "purchase")
    return out.select("day", "n", rnd(F.col("action_rate")).alias("action_rate"), rnd(F.col("avg_7d")).alias("avg_7d"), "anomaly")


@register(
    "session_windows",
    f"""WITH e AS (SELECT user_id, {_TS} AS t FROM events),
g AS (SELECT user_id, t, CASE WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL
                              OR t >= lag(t) OVER (PARTITION BY user_id ORDER BY t) + INTERVAL '12 hours' THEN 1 ELSE 0 END AS nw FROM e),
s AS (SELECT user_id, t, sum(nw) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, {_FMT.format(x='min(t)')} AS created, {_FMT.format(x='max(t)')} AS last_active,
       {_FMT.format(x="max(t) + INTERVAL '12 hours'")} AS expires_at, count(*) AS n_events
FROM s GROUP BY user_id, sid""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user activity sessions closed by a 12-hour idle gap: created, last active, expiry, message count."""
    return wn.session_windows(_events(spark, sf_dir), "user_id", "12 hours")


_ALERTS_CTE = f"""{_ERR_CTE},
{_hist_sql().split("WITH ", 1)[1].split(chr(10) + "SELECT")[0].replace("q AS (", "ph AS (")},
al AS (SELECT 'High5xxRate' AS alertname, 'critical' AS severity, ws FROM er2 WHERE error_ratio > 0.001
       UNION ALL SELECT 'HighP95Latency', 'warning', ws FROM ph WHERE p95_hist > {wn.P95_SLO_SECONDS})"""
_RECEIVER_SQL = "CASE severity WHEN 'critical' THEN 'pagerduty-critical' WHEN 'warning' THEN 'slack-warnings' ELSE 'default-receiver' END"
# Each alert sent is the first one at or after the end of the interval of the one sent before.
_SENT_CTE = f"""al2 AS MATERIALIZED (SELECT * FROM al),
s(alertname, severity, sent) AS (
  SELECT alertname, any_value(severity), min(ws) FROM al2 GROUP BY alertname
  UNION ALL
  SELECT s.alertname, s.severity, (SELECT min(ws) FROM al2 WHERE al2.alertname = s.alertname AND al2.ws >= s.sent + INTERVAL '{DEDUP_HOURS} hours') AS nx
  FROM s WHERE nx IS NOT NULL),
g AS (SELECT s.alertname, 'analytics-api' AS service, s.severity, s.sent, count(*) AS n_grouped
      FROM s JOIN al2 ON al2.alertname = s.alertname AND al2.ws >= s.sent AND al2.ws < s.sent + INTERVAL '{DEDUP_HOURS} hours' GROUP BY ALL)"""


@register(
    "alert_dedup",
    f"""WITH RECURSIVE {_ALERTS_CTE},
{_SENT_CTE}
SELECT alertname, service, severity, {_FMT.format(x='sent')} AS window_start, n_grouped, {_RECEIVER_SQL} AS receiver
FROM g""",
)
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly 5xx / p95 alert instances grouped by (alertname, service); the 6-hour repeat interval runs
    from the last alert sent; routed by severity."""
    log = _log(spark, sf_dir)
    alerts = wn.alert_events(wn.error_ratio(log), wn.latency_p95(log))
    return wn.alert_dedup(alerts, DEDUP_HOURS)


_THROTTLE_SQL = f"""WITH RECURSIVE ev AS (SELECT event_type AS k, epoch_us(CAST(ts AS TIMESTAMP)) AS t, event_id,
                                row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(CAST(ts AS TIMESTAMP)), event_id) AS rn FROM events),
r(k, rn, event_id, t, acc, allowed) AS (
  SELECT k, rn, event_id, t, [t], true FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.event_id, e.t,
         CASE WHEN len(list_filter(r.acc, lambda x: x >= e.t - {THROTTLE_WINDOW_US})) < {THROTTLE_LIMIT}
              THEN list_append(list_filter(r.acc, lambda x: x >= e.t - {THROTTLE_WINDOW_US}), e.t)
              ELSE list_filter(r.acc, lambda x: x >= e.t - {THROTTLE_WINDOW_US}) END,
         len(list_filter(r.acc, lambda x: x >= e.t - {THROTTLE_WINDOW_US})) < {THROTTLE_LIMIT}
  FROM r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1)
SELECT event_id, k AS event_type, allowed FROM r"""
_THROTTLE_REDIS_SQL = f"""WITH RECURSIVE ev AS (SELECT event_type AS k, epoch_us(CAST(ts AS TIMESTAMP)) AS t, event_id,
                                row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(CAST(ts AS TIMESTAMP)), event_id) AS rn FROM events),
r(k, rn, event_id, t, acc, allowed) AS (
  SELECT k, rn, event_id, t, [t], true FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.event_id, e.t,
         CASE WHEN len(list_filter(r.acc, lambda x: x > e.t - {THROTTLE_WINDOW_US})) < {THROTTLE_LIMIT}
              THEN list_append(list_filter(r.acc, lambda x: x > e.t - {THROTTLE_WINDOW_US}), e.t)
              ELSE list_filter(r.acc, lambda x: x > e.t - {THROTTLE_WINDOW_US}) END,
         len(list_filter(r.acc, lambda x: x > e.t - {THROTTLE_WINDOW_US})) < {THROTTLE_LIMIT}
  FROM r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1)
SELECT event_id, k AS event_type, allowed FROM r"""


@register("throttle_audit", _THROTTLE_SQL)
def throttle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding-window limiter audit — per event type at most 2 accepted events in any trailing hour
    (stamps exactly one hour old still count; refused events do not count)."""
    ev = _events(spark, sf_dir).select("event_id", "event_type", F.unix_micros("ts").alias("t_us"))
    out = st.throttle_audit(ev, "event_type", "t_us", "event_id", THROTTLE_LIMIT, THROTTLE_WINDOW_US, inclusive=True)
    return out.join(ev, "event_id").select("event_id", "event_type", "allowed")


_LOGIN_SQL = f"""WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS ip, epoch_us({_TS}) AS t,
                  event_type = 'error' AS f, event_type = 'signup' AS s FROM events WHERE event_type IN ('error', 'signup')),
u AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cumf FROM e),
u2 AS (SELECT *, coalesce(max(CASE WHEN s THEN cumf END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS last_s,
              coalesce(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {LOGIN_WINDOW_US + 1} PRECEDING), 0) AS before_w
       FROM u),
uf AS (SELECT event_id, CAST(cumf - greatest(last_s, before_w) AS BIGINT) AS user_failures FROM u2 WHERE f),
i AS (SELECT event_id, ip, t, sum(1) OVER (PARTITION BY ip ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cumf,
             coalesce(count(*) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {LOGIN_WINDOW_US + 1} PRECEDING), 0) AS before_w
      FROM e WHERE f),
ipf AS (SELECT event_id, CAST(cumf - before_w AS BIGINT) AS ip_failures FROM i),
j AS (SELECT uf.event_id, user_failures, ip_failures FROM uf JOIN ipf USING (event_id)),
p AS (SELECT *, CASE WHEN user_failures >= 8 THEN 'lockout' WHEN user_failures >= 3 THEN 'backoff' ELSE 'none' END AS us,
             CASE WHEN user_failures >= 8 THEN 900 WHEN user_failures >= 3 THEN least(120, 2 * CAST(pow(2, user_failures - 3) AS BIGINT)) ELSE 0 END AS uw,
             CASE WHEN ip_failures >= 8 THEN 'lockout' WHEN ip_failures >= 3 THEN 'backoff' ELSE 'none' END AS iss,
             CASE WHEN ip_failures >= 8 THEN 900 WHEN ip_failures >= 3 THEN least(120, 2 * CAST(pow(2, ip_failures - 3) AS BIGINT)) ELSE 0 END AS iw
      FROM j)
SELECT event_id, user_failures, ip_failures,
       CASE WHEN us = 'lockout' OR iss = 'lockout' THEN 'lockout' WHEN us = 'backoff' OR iss = 'backoff' THEN 'backoff' ELSE 'none' END AS penalty_state,
       CAST(greatest(uw, iw) AS BIGINT) AS retry_after_seconds
FROM p"""


@register("login_guard", _LOGIN_SQL)
def login_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per login failure (error events) the user-scope failures in the last 7 days since the user's last
    success (signup events) and the address-scope failures (props.k), with backoff / lockout state and retry-after."""
    ev = _logins(_events(spark, sf_dir)).withColumns({"t_us": F.unix_micros("ts"), "is_success": ~F.col("is_failure")})
    out = st.login_guard(ev, "event_id", "user_id", "ip", "t_us", "is_failure", "is_success", LOGIN_WINDOW_US)
    return out.select("event_id", F.col("user_failures").cast("long").alias("user_failures"), F.col("ip_failures").cast("long").alias("ip_failures"),
                      "penalty_state", "retry_after_seconds")


def _logins(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("error", "signup")).select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("ip"), "ts", (F.col("event_type") == "error").alias("is_failure"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.event_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


def _streamed(spark: SparkSession, name: str, out: DataFrame, shape=lambda b: b) -> DataFrame:
    path = scratch_path(spark, name)
    tm.run_batches(out, path, scratch_path(spark, f"{name}-ckpt"), shape)
    return spark.read.parquet(path)


@register(
    "login_guard_stream",
    f"""SELECT l.* FROM ({_LOGIN_SQL}) l JOIN events USING (event_id)
WHERE {_TS} <= (SELECT max({_TS}) FROM events WHERE event_type IN ('error', 'signup')) - INTERVAL '{LATENESS}'""",
)
def login_guard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 as Structured Streaming: failure stamps per user and address in list state, decided by event-time timers once the
    10-minute watermark has passed an event; the decisions of all events it has passed."""
    counts = tm.failure_counts(_logins(_event_stream(spark, sf_dir)), LOGIN_WINDOW_US, LATENESS)
    out = _streamed(spark, "login-guard", counts, lambda b: st.with_penalty(tm.both_scopes(b), "event_id"))
    return out.select("event_id", "user_failures", "ip_failures", "penalty_state", "retry_after_seconds")


@register(
    "sustained_alert_stream",
    f"""WITH {_ERR_CTE},
sp AS (SELECT unnest(range((SELECT min(ws) FROM er2), (SELECT max(ws) FROM er2) + INTERVAL '1 second', INTERVAL '1 hour')) AS ws),
fl AS (SELECT sp.ws, coalesce(er2.error_ratio > 0.001, false) AS flag FROM sp LEFT JOIN er2 USING (ws)),
g AS (SELECT ws, flag, row_number() OVER (ORDER BY ws) - row_number() OVER (PARTITION BY flag ORDER BY ws) AS grp FROM fl),
i AS (SELECT min(ws) AS a, max(ws) AS z, count(*) AS n FROM g WHERE flag GROUP BY grp),
wm AS (SELECT max({_TS}) - INTERVAL '{LATENESS}' AS t FROM events)
SELECT 'resolved' AS state, {_FMT.format(x='a')} AS island_start, {_FMT.format(x='z')} AS island_last, n AS n_windows, n >= {SUSTAIN_WINDOWS} AS fired
FROM i WHERE z + INTERVAL '2 hours' <= (SELECT t FROM wm)
UNION ALL
SELECT 'firing', {_FMT.format(x='a')}, {_FMT.format(x=f"a + INTERVAL '{SUSTAIN_WINDOWS - 1} hours'")}, {SUSTAIN_WINDOWS}, true
FROM i WHERE n >= {SUSTAIN_WINDOWS} AND a + INTERVAL '{SUSTAIN_WINDOWS} hours' <= (SELECT t FROM wm)""",
)
def sustained_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10 as Structured Streaming: 'firing' when a breach has held for 3 hourly windows, 'resolved' when its run ends at a
    window without breach or, by an event-time timer, at a silent hour; all runs that the watermark has passed."""
    out = _streamed(spark, "sustained", tm.sustained_runs(wn.request_log(_event_stream(spark, sf_dir)), "1 hour", SUSTAIN_WINDOWS, LATENESS))
    return out.select("state", wn.fmt(F.timestamp_micros("start_us")).alias("island_start"), wn.fmt(F.timestamp_micros("last_us")).alias("island_last"),
                      "n_windows", "fired")


@register(
    "alert_dedup_stream",
    f"""WITH RECURSIVE {_ALERTS_CTE},
{_SENT_CTE}
SELECT alertname, service, severity, {_FMT.format(x='sent')} AS window_start, n_grouped, {_RECEIVER_SQL} AS receiver
FROM g WHERE sent + INTERVAL '{DEDUP_HOURS} hours' <= (SELECT max({_TS}) - INTERVAL '{LATENESS}' FROM events)""",
)
def alert_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14 as Structured Streaming: alerts of closed windows per (alertname, service); the repeat interval runs from the last
    alert sent, an event-time timer ends it; all intervals that the watermark has passed."""
    out = _streamed(spark, "sent-alerts", tm.sent_alerts(wn.request_log(_event_stream(spark, sf_dir)), "1 hour", DEDUP_HOURS, LATENESS))
    return out.select("alertname", "service", "severity", wn.fmt(F.timestamp_micros("sent_us")).alias("window_start"), "n_grouped",
                      wn.receiver().alias("receiver"))


@register(
    "score_stream",
    with_bookings(
        """
SELECT booking_id, proba, action, concat_ws('+',
  CASE WHEN coalesce(adults, 0) = 0 AND coalesce(children, 0) = 0 AND coalesce(babies, 0) = 0 THEN 'zero_guests' END,
  CASE WHEN adr < -10 THEN 'negative_adr' END,
  CASE WHEN coalesce(stays_in_weekend_nights, 0) + coalesce(stays_in_week_nights, 0) > 365 THEN 'extreme_stay' END,
  CASE WHEN lead_time > 800 THEN 'extreme_lead_time' END,
  CASE WHEN adults > 50 THEN 'extreme_adults' END) AS anomalies
FROM a""",
        DECIDE_CTES,
    ),
)
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive as a stream, are enriched by a stream–static join into bookings, tagged with their row anomalies,
    scored and decided per micro-batch in foreachBatch (uplift gate and capacity top-k within each batch); a batch replaces
    its own partition of the actions table."""
    schema = table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    out_path = scratch_path(spark, "stream-actions")
    score_arrivals(bookings(spark, sf_dir, orders=stream), out_path, scratch_path(spark, "stream-actions-ckpt"))
    return spark.read.parquet(out_path).select("booking_id", "proba", "action", "anomalies")


def decide_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """R15 sink: tags, scores and decides one micro-batch and replaces its partition of the actions table."""
    acts = score_and_decide(tag_row_anomalies(batch), "score", "booking_id", FLAGSHIP_POLICY)
    wn.write_batch(acts.select("booking_id", "proba", "action", F.array_join("anomaly_types", "+").alias("anomalies")), batch_id, path)


def score_arrivals(arrivals: DataFrame, path: str, checkpoint: str) -> None:
    """R15 over all arrivals that the source holds now."""
    q = arrivals.writeStream.foreachBatch(lambda b, i: decide_batch(b, i, path)).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


@register("throttle_audit_redis", _THROTTLE_REDIS_SQL)
def throttle_audit_redis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the same limiter with the atomic-script eviction edge — stamps exactly one window old are evicted."""
    ev = _events(spark, sf_dir).select("event_id", "event_type", F.unix_micros("ts").alias("t_us"))
    out = st.throttle_audit(ev, "event_type", "t_us", "event_id", THROTTLE_LIMIT, THROTTLE_WINDOW_US, inclusive=False)
    return out.join(ev, "event_id").select("event_id", "event_type", "allowed")


@register(
    "retrieval_counters",
    f"""SELECT {_FMT.format(x="time_bucket(INTERVAL '1 hour', " + _TS + ")")} AS window_start, event_type AS method,
       CASE WHEN value / 100.0 < 0.55 THEN 'low' WHEN value / 100.0 >= 0.80 THEN 'high' ELSE 'medium' END AS bucket,
       count(*) AS n
FROM events GROUP BY ALL""",
)
def retrieval_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly retrieval counters by method and quality bucket (events as the retrieval log, similarity =
    value / 100, buckets at 0.55 / 0.80)."""
    ev = _events(spark, sf_dir)
    sim = F.col("value") / F.lit(100.0)
    bucket = F.when(sim < 0.55, "low").when(sim >= 0.80, "high").otherwise("medium")
    out = ev.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("method"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return out.select(wn.fmt(F.col("w.start")).alias("window_start"), "method", "bucket", "n")
