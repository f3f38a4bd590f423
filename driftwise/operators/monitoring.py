"""Monitoring: realised outcomes, alerts, validation profiles, run snapshots.

Rows are aligned by key (never by position): actions ⋈ outcomes is an inner
join on the key with the unmatched counts of both sides reported.  Alerts and
profiles are one-row / O(checks) frames assembled from the drift and
evaluation jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.operators import anomaly as an
from driftwise.operators import drift as dr
from driftwise.operators.evaluate import roc_auc
from driftwise.operators.policy import CostMatrix
from driftwise.operators.profile import numeric_profile


def outcome_report(
    actions: DataFrame, outcomes: DataFrame, key: str, actual_col: str, costs: CostMatrix,
    proba_col: str = "proba", action_col: str = "action",
) -> DataFrame:
    """AUC (NULL with one class), Brier, action rate, realised profit, confusion; unmatched counts."""
    if actual_col not in outcomes.columns:
        raise ValueError(f"Outcome column not found: {actual_col}")
    a = actions.select(key, F.col(proba_col).cast("double").alias("proba"), F.coalesce(F.col(action_col).cast("int"), F.lit(0)).alias("action"))
    o = outcomes.select(key, F.coalesce(F.col(actual_col).cast("int"), F.lit(0)).alias("y"))
    flagged = a.withColumn("_a", F.lit(True)).join(o.withColumn("_o", F.lit(True)), key, "full_outer")
    matched = flagged.where(F.col("_a") & F.col("_o"))
    act, y = F.col("action"), F.col("y")
    stats = flagged.agg(
        F.count_if(F.col("_a") & F.col("_o")).alias("n_rows"),
        F.count_if(F.col("_a") & F.col("_o").isNull()).alias("n_unmatched_actions"),
        F.count_if(F.col("_o") & F.col("_a").isNull()).alias("n_unmatched_outcomes"),
        F.avg(F.when(F.col("_a") & F.col("_o"), F.pow(F.col("proba") - y, 2))).alias("brier"),
        F.avg(F.when(F.col("_a") & F.col("_o"), act.cast("double"))).alias("action_rate"),
        F.count_if(F.col("_o") & F.col("_a") & (act == 1) & (y == 1)).alias("tp"),
        F.count_if(F.col("_o") & F.col("_a") & (act == 1) & (y == 0)).alias("fp"),
        F.count_if(F.col("_o") & F.col("_a") & (act == 0) & (y == 1)).alias("fn"),
        F.count_if(F.col("_o") & F.col("_a") & (act == 0) & (y == 0)).alias("tn"),
    )
    auc = roc_auc(matched, "proba", "y").first()[0]
    profit = (
        F.col("tp") * F.lit(costs.tp_value) + F.col("fp") * F.lit(costs.fp_value)
        + F.col("fn") * F.lit(costs.fn_value) + F.col("tn") * F.lit(costs.tn_value)
    ).cast("double")
    return (
        stats.withColumn("auc", F.lit(auc).cast("double"))
        .withColumn("realized_profit", profit)
    )


@dataclass(frozen=True)
class AlertThresholds:
    data_drift_psi: float = 0.2
    prediction_drift_psi: float = 0.2
    profit_drop_ratio: float = 0.2
    action_rate_tolerance: float = 0.05


def build_alerts(
    max_psi: float, prediction_psi: float, realized_profit: float | None, action_rate: float | None,
    expected_profit: float | None, expected_action_rate: float | None, volume_anomalous: bool,
    t: AlertThresholds = AlertThresholds(),
) -> dict[str, object]:
    """O2: alert flags from report numbers (driver-side: inputs are O(1) numbers of upstream jobs)."""
    alerts: dict[str, object] = {
        "data_drift": (max_psi or 0.0) >= t.data_drift_psi,
        "prediction_drift": (prediction_psi or 0.0) >= t.prediction_drift_psi,
        "profit_drop": False,
        "action_rate_deviation": False,
        "data_volume_anomaly": bool(volume_anomalous),
        "profit_drop_ratio": None,
        "action_rate_delta": None,
    }
    if expected_profit is not None and realized_profit is not None:
        ratio = 1.0 - (realized_profit / expected_profit) if expected_profit != 0 else 0.0
        alerts["profit_drop"] = ratio >= t.profit_drop_ratio
        alerts["profit_drop_ratio"] = ratio
    if expected_action_rate is not None and action_rate is not None:
        alerts["action_rate_deviation"] = abs(action_rate - expected_action_rate) >= t.action_rate_tolerance
        alerts["action_rate_delta"] = action_rate - expected_action_rate
    alerts["any_alert"] = any(
        alerts[k] for k in ("data_drift", "prediction_drift", "profit_drop", "action_rate_deviation", "data_volume_anomaly")
    )
    return alerts


@dataclass(frozen=True)
class CheckConfig:
    severity: str  # warn | soft_fail | hard_fail
    enabled: bool = True
    threshold: float = 0.0


@dataclass(frozen=True)
class ValidationPolicy:
    """The reference's base validation policy (severities and thresholds)."""

    duplicate: CheckConfig = CheckConfig("warn", True, 0.02)
    volume: CheckConfig = CheckConfig("hard_fail", True, 0.50)
    row_anomaly: CheckConfig = CheckConfig("warn", True, 0.0)
    distribution_drift: CheckConfig = CheckConfig("warn", True, 3.0)
    psi_drift: CheckConfig = CheckConfig("soft_fail", True, 0.10)
    psi_block_threshold: float = 0.25
    psi_metric: str = "psi"
    psi_n_bins: int = 10
    column_drift_thresholds: Mapping[str, float] = field(default_factory=dict)
    critical_columns: Sequence[str] = ()
    label_drift: CheckConfig = CheckConfig("soft_fail", True, 0.10)


def validation_profile(
    df: DataFrame, reference: DataFrame, target: str, numeric_cols: Sequence[str], policy: ValidationPolicy = ValidationPolicy()
) -> list[tuple[str, str, bool]]:
    """Run enabled checks; (check, severity, violated) rows plus ('passed', 'summary', no hard failure).

    The reference profile carries ``n_rows`` and ``label_positive_rate`` (the
    keys volume and label drift need), computed here from ``reference``.
    """
    rows: list[tuple[str, str, bool]] = []
    ref_row = reference.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("rate")).first()
    hard = False

    def apply(name: str, cfg: CheckConfig, violated: bool) -> None:
        nonlocal hard
        if not cfg.enabled:
            return
        rows.append((name, cfg.severity, bool(violated)))
        if violated and cfg.severity == "hard_fail":
            hard = True

    dup = an.duplicate_report(df).first()
    apply("duplicate", policy.duplicate, dup["duplicate_ratio"] > policy.duplicate.threshold)
    vol = an.volume_check(df, int(ref_row["n"]), policy.volume.threshold).first()
    apply("volume", policy.volume, vol["is_anomalous"])
    anom = an.row_anomaly_counts(df).first()
    apply("row_anomaly", policy.row_anomaly, anom["n_anomalies"] > 0)
    ref_stats = numeric_profile(reference, numeric_cols, digits=None, quantiles=False)
    viol = dr.distribution_violations(df, ref_stats, policy.distribution_drift.threshold).count()
    apply("distribution_drift", policy.distribution_drift, viol > 0)
    psi = dr.drift_scores(
        reference, df, numeric_cols, policy.psi_n_bins, policy.psi_metric, policy.psi_drift.threshold,
        policy.psi_block_threshold, policy.column_drift_thresholds, policy.critical_columns,
    ).collect()
    for r in psi:
        if r["status"] == "warn":
            rows.append((f"psi_warn:{r['column_name']}", "warn", True))
    apply("psi_drift", policy.psi_drift, any(r["status"] == "drift" for r in psi))
    ld = dr.label_drift(df, target, float(ref_row["rate"] or 0.0), policy.label_drift.threshold).first()
    apply("label_drift", policy.label_drift, ld["is_drifted"])
    rows.append(("passed", "summary", not hard))
    return rows
