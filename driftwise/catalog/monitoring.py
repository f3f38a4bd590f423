"""Named queries for monitoring (step 8): outcomes, alerts, validation profile, report, run snapshot."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.catalog.sqlgen import binned_counts_ctes, divergence_select, long_union
from driftwise.catalog.drift import _STATS_CTES, CATEGORY_COLS, CRITICAL, DRIFT_COLS, THRESHOLD_OVERRIDES
from driftwise.functions.scalar import pround, rnd
from driftwise.operators import anomaly as an
from driftwise.operators import drift as dr
from driftwise.operators import evaluate as ev
from driftwise.operators import monitoring as mon
from driftwise.operators import split as sp
from driftwise.operators.policy import CostMatrix, decide_actions
from driftwise.sources.files import scratch_path
from driftwise.sources.tables import bookings

COSTS = CostMatrix()
THRESHOLD = 0.5


def _periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = bookings(spark, sf_dir)
    return b, b.where(F.col("period") == "ref"), b.where(F.col("period") == "cur")


def _actions(df: DataFrame) -> DataFrame:
    return decide_actions(df.select("booking_id", F.col("score").alias("proba")), "proba", "booking_id", THRESHOLD)


_OUTCOME_CTES = """
a AS (SELECT booking_id, score AS proba, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS action FROM bookings WHERE period = 'cur'),
o AS (SELECT booking_id, y FROM bookings),
m AS (SELECT a.booking_id, a.proba, a.action, o.y FROM a JOIN o USING (booking_id)),
g AS (SELECT proba, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY proba),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"""


@register(
    "outcome_report",
    with_bookings(
        """
SELECT n_rows, n_unmatched_actions, n_unmatched_outcomes, round(brier, 6) AS brier, round(action_rate, 6) AS action_rate,
       tp, fp, fn, tn, round(auc, 6) AS auc, round(CAST(tp * 180.0 + fp * -20.0 + fn * -200.0 + tn * 0.0 AS DOUBLE), 6) AS realized_profit
FROM (SELECT count(*) AS n_rows, avg(pow(proba - y, 2)) AS brier, avg(CAST(action AS DOUBLE)) AS action_rate,
             count_if(action = 1 AND y = 1) AS tp, count_if(action = 1 AND y = 0) AS fp,
             count_if(action = 0 AND y = 1) AS fn, count_if(action = 0 AND y = 0) AS tn FROM m) s,
     (SELECT count(*) AS n_unmatched_actions FROM a WHERE booking_id NOT IN (SELECT booking_id FROM o)) ua,
     (SELECT count(*) AS n_unmatched_outcomes FROM o WHERE booking_id NOT IN (SELECT booking_id FROM a)) uo,
     (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc FROM c) k""",
        _OUTCOME_CTES,
    ),
)
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current-period actions (score ≥ 0.5) joined by key to realised outcomes y of all bookings;
    AUC, Brier, action rate, realised profit, confusion and unmatched counts of both sides."""
    b, _, cur = _periods(spark, sf_dir)
    rep = mon.outcome_report(_actions(cur), b.select("booking_id", "y"), "booking_id", "y", COSTS)
    return rep.select(
        "n_rows", "n_unmatched_actions", "n_unmatched_outcomes", rnd(F.col("brier")).alias("brier"),
        rnd(F.col("action_rate")).alias("action_rate"), "tp", "fp", "fn", "tn", rnd(F.col("auc")).alias("auc"),
        rnd(F.col("realized_profit")).alias("realized_profit"),
    )


def _alerts(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    b, ref, cur = _periods(spark, sf_dir)
    num = dr.divergence(dr.binned_counts(ref, cur, DRIFT_COLS, 10), 10, "psi").select("score")
    cat = dr.categorical_psi(ref, cur, CATEGORY_COLS).select(F.col("psi").alias("score"))
    max_psi = num.unionByName(cat).agg(F.max("score")).first()[0]
    pred = dr.prediction_drift(ref, cur, "score", 10).first()
    pred_psi = pred["psi"]
    outcome = mon.outcome_report(_actions(cur), b.select("booking_id", "y"), "booking_id", "y", COSTS).first()
    # expectation from the reference period under the same rule, scaled to the current row count
    exp = mon.outcome_report(_actions(ref), ref.select("booking_id", "y"), "booking_id", "y", COSTS).first()
    expected_profit = exp["realized_profit"] / exp["n_rows"] * outcome["n_rows"] if exp["n_rows"] else None
    vol = an.volume_check(cur, ref.count(), 0.5).first()["is_anomalous"]
    alerts = mon.build_alerts(
        max_psi, pred_psi, outcome["realized_profit"], outcome["action_rate"], expected_profit, exp["action_rate"], vol
    )
    alerts.update(max_psi=max_psi, prediction_psi=pred_psi, ks_stat=pred["ks_stat"])
    return alerts


def _alerts_sql() -> str:
    from driftwise.catalog.drift import _CAT_PSI_CTES, _PRED_CTES

    pred_ctes = _PRED_CTES.strip()
    for name in ("pts", "hb", "grid", "hc", "sh0", "sh", "g2", "cum", "tot"):
        pred_ctes = re.sub(rf"\b{name}\b", f"pd_{name}", pred_ctes)
    return with_bookings(
        """
SELECT max_psi >= 0.2 AS data_drift, pred_psi >= 0.2 AS prediction_drift, drop_ratio >= 0.2 AS profit_drop,
       abs(ar_delta) >= 0.05 AS action_rate_deviation, vol_bad AS data_volume_anomaly,
       max_psi >= 0.2 OR pred_psi >= 0.2 OR drop_ratio >= 0.2 OR abs(ar_delta) >= 0.05 OR vol_bad AS any_alert,
       round(max_psi, 6) AS max_psi, round(pred_psi, 6) AS prediction_psi, round(drop_ratio, 6) AS profit_drop_ratio,
       round(ar_delta, 6) AS action_rate_delta
FROM (SELECT (SELECT max(v) FROM (SELECT score AS v FROM scores UNION ALL SELECT psi FROM cpsi)) AS max_psi,
             (SELECT sum((c.p - r.p) * ln(c.p / r.p)) FROM pd_sh r JOIN pd_sh c ON r.bin = c.bin AND r.side = 'ref' AND c.side = 'cur') AS pred_psi,
             CASE WHEN oe.expected <> 0 THEN 1.0 - oc.realized / oe.expected ELSE 0.0 END AS drop_ratio,
             oc.ar - oe.ar AS ar_delta,
             (SELECT n_cur < greatest(1, CAST(floor(n_ref * 0.5) AS BIGINT)) OR n_cur > CAST(floor(n_ref * 1.5) AS BIGINT)
              FROM (SELECT count_if(period = 'cur') AS n_cur, count_if(period = 'ref') AS n_ref FROM bookings)) AS vol_bad
      FROM oc, oe)""",
        binned_counts_ctes(long_union(DRIFT_COLS)).strip() + "," + divergence_select("psi") + "," + _CAT_PSI_CTES + ",\n" + pred_ctes + """,
oc AS (SELECT CAST(sum(CASE WHEN score >= 0.5 AND y = 1 THEN 180.0 WHEN score >= 0.5 AND y = 0 THEN -20.0
                            WHEN score < 0.5 AND y = 1 THEN -200.0 ELSE 0.0 END) AS DOUBLE) AS realized,
              avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS ar, count(*) AS n FROM bookings WHERE period = 'cur'),
oe AS (SELECT CAST(sum(CASE WHEN score >= 0.5 AND y = 1 THEN 180.0 WHEN score >= 0.5 AND y = 0 THEN -20.0
                            WHEN score < 0.5 AND y = 1 THEN -200.0 ELSE 0.0 END) AS DOUBLE) / count(*) * (SELECT n FROM oc) AS expected,
              avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS ar FROM bookings WHERE period = 'ref')""",
    )


@register("build_alerts", _alerts_sql())
def build_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: data drift (max PSI ≥ 0.2), prediction drift (PSI ≥ 0.2), profit drop (≥ 20 % below the
    reference-period expectation), action-rate deviation (≥ 0.05), volume anomaly, any_alert."""
    a = _alerts(spark, sf_dir)
    row = (
        bool(a["data_drift"]), bool(a["prediction_drift"]), bool(a["profit_drop"]), bool(a["action_rate_deviation"]),
        bool(a["data_volume_anomaly"]), bool(a["any_alert"]), pround(a["max_psi"]), pround(a["prediction_psi"]),
        pround(a["profit_drop_ratio"]), pround(a["action_rate_delta"]),
    )
    return spark.createDataFrame(
        [row],
        "data_drift boolean, prediction_drift boolean, profit_drop boolean, action_rate_deviation boolean, "
        "data_volume_anomaly boolean, any_alert boolean, max_psi double, prediction_psi double, "
        "profit_drop_ratio double, action_rate_delta double",
    )


_BOOKING_COLS = (
    "booking_id, booked_on, period, is_canceled, y, hotel, arrival_date_year, arrival_date_month, arrival_date_day_of_month, "
    "lead_time, adults, children, babies, stays_in_week_nights, stays_in_weekend_nights, adr, country, market_segment, "
    "customer_type, score"
)
_PROFILE_SQL = with_bookings(
    f"""
SELECT * FROM (
  SELECT 'duplicate' AS check_name, 'warn' AS severity,
         (SELECT sum(c) - count(*) FROM (SELECT count(*) AS c FROM cur GROUP BY {_BOOKING_COLS})) / CAST((SELECT count(*) FROM cur) AS DOUBLE) > 0.02 AS violated
  UNION ALL SELECT 'volume', 'hard_fail', vol_bad FROM vol
  UNION ALL SELECT 'row_anomaly', 'warn', count_if(coalesce(adults, 0) = 0 AND coalesce(children, 0) = 0 AND coalesce(babies, 0) = 0
         OR adr < -10 OR coalesce(stays_in_weekend_nights, 0) + coalesce(stays_in_week_nights, 0) > 365 OR lead_time > 800 OR adults > 50) > 0 FROM cur
  UNION ALL SELECT 'distribution_drift', 'warn', (SELECT count(*) FROM j WHERE
         (c_n > 0 AND r_std > 0 AND abs(c_mean - r_mean) > 3.0 * r_std) OR c_n = 0
         OR (c_n > 0 AND c_min < r_min * 0.5 - abs(r_min)) OR (c_n > 0 AND c_max > r_max * 2.0 + abs(r_max))) > 0
  UNION ALL SELECT 'psi_warn:' || column_name, 'warn', true FROM st WHERE status = 'warn'
  UNION ALL SELECT 'psi_drift', 'soft_fail', count_if(status = 'drift') > 0 FROM st
  UNION ALL SELECT 'label_drift', 'soft_fail', abs(coalesce((SELECT avg(CAST(y AS DOUBLE)) FROM cur), 0.0) - (SELECT avg(CAST(y AS DOUBLE)) FROM ref)) > 0.10
  UNION ALL SELECT 'passed', 'summary', NOT vol_bad FROM vol)""",
    _STATS_CTES
    + ",\n"
    + binned_counts_ctes(long_union(DRIFT_COLS)).strip()
    + ","
    + divergence_select("psi")
    + """,
st AS (SELECT column_name, CASE WHEN score >= (CASE WHEN column_name = 'lead_time' THEN 0.15 WHEN column_name = 'adr' THEN 0.10 ELSE 0.25 END) THEN 'drift'
            WHEN score >= (CASE WHEN column_name = 'lead_time' THEN 0.15 ELSE 0.10 END) THEN 'warn' ELSE 'stable' END AS status
       FROM scores WHERE n_ref >= 5 AND n_cur >= 5),
vol AS (SELECT n_cur < greatest(1, CAST(floor(n_ref * 0.5) AS BIGINT)) OR n_cur > CAST(floor(n_ref * 1.5) AS BIGINT) AS vol_bad
        FROM (SELECT (SELECT count(*) FROM cur) AS n_cur, (SELECT count(*) FROM ref) AS n_ref))""",
)


@register("validation_profile", _PROFILE_SQL)
def validation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate, volume, row-anomaly, distribution, PSI (lead_time override, adr critical) and label
    checks of the current period against the reference profile, with severities; 'passed' = no hard failure."""
    _, ref, cur = _periods(spark, sf_dir)
    policy = mon.ValidationPolicy(column_drift_thresholds=THRESHOLD_OVERRIDES, critical_columns=tuple(CRITICAL))
    rows = mon.validation_profile(cur, ref, "y", DRIFT_COLS, policy)
    return spark.createDataFrame(rows, "check_name string, severity string, violated boolean")


def _report_sql() -> str:
    """O3 twin: the report row from the drift, outcome and alert CTEs (shared names renamed apart)."""
    from driftwise.catalog.drift import _CAT_PSI_CTES, _CUR_REF, _IMP_CTES, _PRED_CTES, _TRACKED

    tracked = _TRACKED.replace(_CUR_REF + ",", "", 1)
    for name in ("cc_p", "cc"):
        tracked = re.sub(rf"\b{name}\b", f"t_{name}", tracked)
    imp = _IMP_CTES.replace(_CUR_REF + ",", "", 1)
    pred = _PRED_CTES.strip()
    for name in ("pts", "hb", "grid", "hc", "sh0", "sh", "g2", "cum", "tot"):
        pred = re.sub(rf"\b{name}\b", f"pd_{name}", pred)
    ctes = ",\n".join([
        _STATS_CTES, tracked.strip(), imp.strip(), binned_counts_ctes(long_union(DRIFT_COLS)).strip(),
        divergence_select("psi").strip(), _CAT_PSI_CTES.strip(), pred,
        _OUTCOME_PAIR_CTES.strip(),
    ])
    body = """
SELECT n_distribution_violations, label_drift, label_drift_magnitude, n_corr_drifted, n_importance_changed,
       round(max_psi, 6) AS max_psi, round(pred_psi, 6) AS prediction_psi, round(ks, 6) AS ks_stat, vol_bad AS volume_anomaly,
       max_psi >= 0.2 OR pred_psi >= 0.2 OR drop_ratio >= 0.2 OR abs(ar_delta) >= 0.05 OR vol_bad AS any_alert
FROM (SELECT
  CAST((SELECT count(*) FROM j WHERE (c_n > 0 AND r_std > 0 AND abs(c_mean - r_mean) > 3.0 * r_std) OR c_n = 0
        OR (c_n > 0 AND c_min < r_min * 0.5 - abs(r_min)) OR (c_n > 0 AND c_max > r_max * 2.0 + abs(r_max))) AS INTEGER) AS n_distribution_violations,
  abs(coalesce((SELECT avg(CAST(y AS DOUBLE)) FROM cur), 0.0) - (SELECT avg(CAST(y AS DOUBLE)) FROM ref)) > 0.10 AS label_drift,
  round(abs(coalesce((SELECT avg(CAST(y AS DOUBLE)) FROM cur), 0.0) - (SELECT avg(CAST(y AS DOUBLE)) FROM ref)), 6) AS label_drift_magnitude,
  CAST((SELECT count(*) FROM tracked tr JOIN rc r1 ON r1.a = tr.a AND r1.b = tr.b JOIN t_cc r2 ON r2.a = tr.a AND r2.b = tr.b
        WHERE abs(r2.r - r1.r) > 0.20) AS INTEGER) AS n_corr_drifted,
  CAST((SELECT count(*) FROM ri r JOIN ci c USING (feature) WHERE r.rk < 10 AND abs(c.rk - r.rk) >= 5) AS INTEGER) AS n_importance_changed,
  (SELECT max(v) FROM (SELECT score AS v FROM scores UNION ALL SELECT psi FROM cpsi)) AS max_psi,
  (SELECT sum((c.p - r.p) * ln(c.p / r.p)) FROM pd_sh r JOIN pd_sh c ON r.bin = c.bin AND r.side = 'ref' AND c.side = 'cur') AS pred_psi,
  (SELECT coalesce(max(abs(ca / na - cb / nb)), 0.0) FROM pd_cum, pd_tot) AS ks,
  (SELECT CASE WHEN oe.expected <> 0 THEN 1.0 - oc.realized / oe.expected ELSE 0.0 END FROM oc, oe) AS drop_ratio,
  (SELECT oc.ar - oe.ar FROM oc, oe) AS ar_delta,
  (SELECT n_cur < greatest(1, CAST(floor(n_ref * 0.5) AS BIGINT)) OR n_cur > CAST(floor(n_ref * 1.5) AS BIGINT)
   FROM (SELECT count_if(period = 'cur') AS n_cur, count_if(period = 'ref') AS n_ref FROM bookings)) AS vol_bad)"""
    return with_bookings(body, ctes)


_OUTCOME_PAIR_CTES = """
oc AS (SELECT CAST(sum(CASE WHEN score >= 0.5 AND y = 1 THEN 180.0 WHEN score >= 0.5 AND y = 0 THEN -20.0
                            WHEN score < 0.5 AND y = 1 THEN -200.0 ELSE 0.0 END) AS DOUBLE) AS realized,
              avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS ar, count(*) AS n FROM bookings WHERE period = 'cur'),
oe AS (SELECT CAST(sum(CASE WHEN score >= 0.5 AND y = 1 THEN 180.0 WHEN score >= 0.5 AND y = 0 THEN -20.0
                            WHEN score < 0.5 AND y = 1 THEN -200.0 ELSE 0.0 END) AS DOUBLE) / count(*) * (SELECT n FROM oc) AS expected,
              avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS ar FROM bookings WHERE period = 'ref')"""


@register("monitoring_report", _report_sql())
def monitoring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: one report row — D1 violations, D2 label drift, D4 drifted pairs, D6 changed ranks, V12 volume,
    D12 max/mean PSI, D13 prediction PSI/KS, O1 outcome and O2 alerts."""
    from driftwise.catalog.drift import correlation_drift, distribution_check, importance_drift, label_drift

    a = _alerts(spark, sf_dir)
    d1 = distribution_check(spark, sf_dir).count()
    d2 = label_drift(spark, sf_dir).first()
    d4 = correlation_drift(spark, sf_dir).where("drifted").count()
    d6 = importance_drift(spark, sf_dir).where("changed").count()
    row = (
        int(d1), bool(d2["is_drifted"]), float(d2["drift_magnitude"]), int(d4), int(d6), pround(a["max_psi"]),
        pround(a["prediction_psi"]), pround(a["ks_stat"]), bool(a["data_volume_anomaly"]), bool(a["any_alert"]),
    )
    return spark.createDataFrame(
        [row],
        "n_distribution_violations int, label_drift boolean, label_drift_magnitude double, n_corr_drifted int, "
        "n_importance_changed int, max_psi double, prediction_psi double, ks_stat double, volume_anomaly boolean, any_alert boolean",
    )


_MODELS = {"score": lambda: F.col("score"), "lead_norm": lambda: F.col("lead_time").cast("double") / F.lit(906.0)}


def _long_models(df: DataFrame, extra: list[str]) -> DataFrame:
    parts = [df.select(*extra, F.lit(name).alias("model"), fn().alias("p"), "y") for name, fn in _MODELS.items()]
    return parts[0].unionByName(parts[1])


@register(
    "run_snapshot",
    with_bookings(
        """
SELECT coalesce(t.model, cv.model) AS model_name, round(cv.m, 6) AS train_cv_roc_auc_mean, round(cv.s, 6) AS train_cv_roc_auc_std,
       cv.folds AS cv_folds, round(t.auc, 6) AS test_roc_auc, round(t.f1, 6) AS test_f1, round(t.prec, 6) AS test_precision,
       round(t.rec, 6) AS test_recall, 0.5 AS test_threshold, t.n AS n_test, round(t.pr, 6) AS positive_rate_test
FROM t FULL OUTER JOIN cv ON cv.model = t.model""",
        """
lm AS (SELECT period, booking_id, y, 'score' AS model, score AS p FROM bookings
       UNION ALL SELECT period, booking_id, y, 'lead_norm', CAST(lead_time AS DOUBLE) / 906.0 FROM bookings),
cur AS (SELECT * FROM lm WHERE period = 'cur'),
g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM cur GROUP BY ALL),
c AS (SELECT model, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
auc AS (SELECT model, sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM c GROUP BY model),
cm AS (SELECT model, count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 1) AS fn,
              count(*) AS n, avg(CAST(y AS DOUBLE)) AS pr FROM cur GROUP BY model),
t AS (SELECT cm.model, auc.auc, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
             coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS prec, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS rec,
             n, pr FROM cm JOIN auc USING (model)),
hk AS (SELECT booking_id, y, CAST(('0x' || substr(md5(CAST(booking_id AS VARCHAR) || ':7'), 1, 13)) AS BIGINT) AS h FROM bookings WHERE period = 'ref'),
fk AS (SELECT booking_id, CAST((row_number() OVER (PARTITION BY y ORDER BY h, booking_id) - 1) % 5 AS INTEGER) AS fold FROM hk),
ref AS (SELECT lm.model, lm.p, lm.y, fk.fold FROM lm JOIN fk USING (booking_id) WHERE lm.period = 'ref'),
gf AS (SELECT model, fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM ref GROUP BY ALL),
cf AS (SELECT model, fold, pos, neg,
              coalesce(sum(neg) OVER (PARTITION BY model, fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gf),
af AS (SELECT model, fold, sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM cf GROUP BY ALL),
cv AS (SELECT model, avg(auc) AS m, stddev_pop(auc) AS s, count(*) AS folds FROM af GROUP BY model)""",
    ),
)
def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-model test metrics written as ``<model>_metrics`` JSON folders and a CV summary
    (5 stratified folds of the reference period), read back by glob with the model name taken from the
    path, full-outer joined on model name and ordered by test AUC (NULLs last)."""
    b, ref, cur = _periods(spark, sf_dir)
    run = scratch_path(spark, "run")
    long_cur = _long_models(cur, [])
    auc = ev.roc_auc(long_cur, "p", "y", ["model"])
    cm = long_cur.groupBy("model").agg(
        F.count_if((F.col("p") >= THRESHOLD) & (F.col("y") == 1)).alias("tp"),
        F.count_if((F.col("p") >= THRESHOLD) & (F.col("y") == 0)).alias("fp"),
        F.count_if((F.col("p") < THRESHOLD) & (F.col("y") == 1)).alias("fn"),
        F.count(F.lit(1)).alias("n_test"), F.avg(F.col("y").cast("double")).alias("positive_rate_test"),
    )
    precision, recall, f1 = ev.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    metrics = cm.join(auc, "model").select(
        "model", F.col("roc_auc"), f1.alias("f1"), precision.alias("precision"), recall.alias("recall"),
        F.lit(THRESHOLD).alias("threshold"), "n_test", "positive_rate_test",
    )
    for name in _MODELS:
        metrics.where(F.col("model") == name).drop("model").coalesce(1).write.mode("overwrite").json(f"{run}/{name}_metrics")
    folds = sp.kfold(ref.select("booking_id", "y", "score", "lead_time"), "booking_id", "y", 5)
    fold_auc = ev.roc_auc(_long_models(folds, ["fold"]), "p", "y", ["model", "fold"])
    cv = fold_auc.groupBy("model").agg(
        F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_pop("roc_auc").alias("roc_auc_std"), F.count(F.lit(1)).alias("cv_folds")
    )
    cv.coalesce(1).write.mode("overwrite").json(f"{run}/cv_summary")
    # Glob the metric folders back; the model name comes from the folder name
    test = spark.read.json(f"{run}/*_metrics/*.json").withColumn(
        "model_name", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)_metrics/[^/]*$", 1)
    )
    test = test.where(F.col("roc_auc").isNotNull() & F.col("f1").isNotNull() & F.col("precision").isNotNull() & F.col("recall").isNotNull())
    cvr = spark.read.json(f"{run}/cv_summary/*.json").withColumnRenamed("model", "cv_model")
    j = test.join(cvr, test.model_name == cvr.cv_model, "full_outer")
    return j.select(
        F.coalesce("model_name", "cv_model").alias("model_name"),
        rnd(F.col("roc_auc_mean")).alias("train_cv_roc_auc_mean"), rnd(F.col("roc_auc_std")).alias("train_cv_roc_auc_std"),
        F.col("cv_folds").cast("long").alias("cv_folds"), rnd(F.col("roc_auc")).alias("test_roc_auc"),
        rnd(F.col("f1")).alias("test_f1"), rnd(F.col("precision")).alias("test_precision"), rnd(F.col("recall")).alias("test_recall"),
        F.col("threshold").cast("double").alias("test_threshold"), F.col("n_test").cast("long").alias("n_test"),
        rnd(F.col("positive_rate_test")).alias("positive_rate_test"),
    ).orderBy(F.desc_nulls_last("test_roc_auc"))


_CHAIN_SQL = with_bookings(
    """
SELECT * FROM (
  SELECT 'processed_contract_failures' AS check_name,
         CAST(count_if(y IS NULL) + count_if(y NOT IN (0, 1)) + count_if(lead_time IS NULL) + count_if(adults IS NULL)
              + count_if(children IS NULL) + count_if(babies IS NULL) + count_if(adr IS NULL OR isnan(adr))
              + count_if(stays_in_week_nights IS NULL) + count_if(stays_in_weekend_nights IS NULL)
              + count_if(arrival_date_year IS NULL) + count_if(arrival_date_day_of_month IS NULL) AS BIGINT) AS value FROM bookings
  UNION ALL SELECT 'row_anomalies', count_if(coalesce(adults, 0) = 0 AND coalesce(children, 0) = 0 AND coalesce(babies, 0) = 0
         OR adr < -10 OR coalesce(stays_in_weekend_nights, 0) + coalesce(stays_in_week_nights, 0) > 365 OR lead_time > 800 OR adults > 50)
         FROM bookings
  UNION ALL SELECT 'profiled_columns', count(*) FROM j
  UNION ALL SELECT 'skewed_features', count(*) FROM j WHERE c_n > 0 AND r_std > 0 AND abs(c_mean - r_mean) > 2.0 * r_std
  UNION ALL SELECT 'psi_drifted_columns', count(*) FROM scores WHERE n_ref >= 5 AND n_cur >= 5 AND score >=
         (CASE WHEN column_name = 'lead_time' THEN 0.15 WHEN column_name = 'adr' THEN 0.10 ELSE 0.25 END))""",
    _STATS_CTES + ",\n" + binned_counts_ctes(long_union(DRIFT_COLS)).strip() + "," + divergence_select("psi"),
)


@register("validation_chain", _CHAIN_SQL)
def validation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's timed validation chain on the bookings table: processed contract (V2), row anomalies (V7),
    reference stats (A1), training-serving skew (D5) and multi-column PSI (D9); one row per check."""
    from driftwise.catalog.validation import CATEGORICAL as V_CAT
    from driftwise.catalog.validation import NUMERIC as V_NUM
    from driftwise.operators import checks as ck
    from driftwise.operators.profile import numeric_profile
    from driftwise.sources.tables import materialized_bookings

    with materialized_bookings(spark, sf_dir) as b:
        ref, cur = b.where(F.col("period") == "ref"), b.where(F.col("period") == "cur")
        contract = ck.violation_counts(b, ck.processed_contract("y", V_NUM, V_CAT)).agg(F.sum("n_failed")).first()[0]
        anomalies = an.row_anomaly_counts(b).first()["n_anomalies"]
        stats = numeric_profile(ref, DRIFT_COLS, digits=None)
        n_stats = stats.count()
        skewed = dr.serving_skew(cur, stats, DRIFT_COLS, 2.0).count()
        psi = dr.drift_scores(ref, cur, DRIFT_COLS, 10, "psi", 0.10, 0.25, THRESHOLD_OVERRIDES, CRITICAL)
        drifted = psi.where(F.col("status") == "drift").count()
    rows = [("processed_contract_failures", int(contract)), ("row_anomalies", int(anomalies)), ("profiled_columns", int(n_stats)),
            ("skewed_features", int(skewed)), ("psi_drifted_columns", int(drifted))]
    return spark.createDataFrame(rows, "check_name string, value long")
