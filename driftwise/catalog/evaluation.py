"""Named queries for evaluation, threshold sweeps and decisions (step 7).

The "model" under evaluation is the bookings ``score`` column (and, for the
champion choice, a second data-derived score ``lead_norm``); the label is ``y``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.catalog.decision import PROXY_SEGMENT_TP
from driftwise.functions.scalar import pround, rnd
from driftwise.operators import evaluate as ev
from driftwise.operators.policy import DEFAULT_ACTION_RATES, CostMatrix, decide_actions, incremental_profit_score
from driftwise.plans.ordering import exact_quantiles
from driftwise.sources.tables import bookings

COSTS = CostMatrix()
MODELS = {"score": lambda: F.col("p"), "lead_norm": lambda: F.col("lead_time").cast("double") / F.lit(906.0)}
PREFER = ["lead_norm", "score"]


def _grid_sql(grid, name="grid"):
    vals = ", ".join(repr(float(v)) for v in grid)
    return f"{name} AS (SELECT unnest([{vals}]) AS threshold)"


def _scored(spark, sf_dir):
    return bookings(spark, sf_dir).select("booking_id", "y", "customer_type", "lead_time", F.col("score").alias("p"))


_S = "s AS (SELECT booking_id, y, customer_type, lead_time, score AS p FROM bookings)"
_AUC_CTES = f"""{_S},
g AS (SELECT customer_type, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL),
c AS (SELECT customer_type, pos, neg,
             coalesce(sum(neg) OVER (PARTITION BY customer_type ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM g)"""


@register(
    "roc_auc_exact",
    with_bookings(
        """
SELECT customer_type, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
       THEN sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END, 6) AS roc_auc
FROM c GROUP BY customer_type""",
        _AUC_CTES,
    ),
)
def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ROC AUC of score vs y per customer segment (rank-sum over grouped scores, grouped prefix sums)."""
    out = ev.roc_auc(_scored(spark, sf_dir), "p", "y", ["customer_type"])
    return out.select("customer_type", rnd(F.col("roc_auc")).alias("roc_auc"))


@register(
    "binary_metrics",
    with_bookings(
        """
SELECT round(a.auc, 6) AS roc_auc, tp, fp, fn, tn, n, round(pos_rate, 6) AS positive_rate,
       round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0), 6) AS f1
FROM (SELECT count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp,
             count_if(p < 0.5 AND y = 1) AS fn, count_if(p < 0.5 AND y = 0) AS tn, count(*) AS n,
             avg(CAST(y AS DOUBLE)) AS pos_rate FROM s) m,
     (SELECT sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM c2) a""",
        f"""{_S},
g2 AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
c2 AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g2)""",
    ),
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, confusion matrix, precision, recall, F1, n and positive rate at threshold 0.5."""
    s = _scored(spark, sf_dir)
    auc = ev.roc_auc(s, "p", "y").first()["roc_auc"]
    c = ev.confusion(s, "p", "y", 0.5)
    precision, recall, f1 = ev.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(
        rnd(F.lit(auc).cast("double")).alias("roc_auc"), "tp", "fp", "fn", "tn", "n",
        rnd(F.col("positive_rate")).alias("positive_rate"),
        rnd(precision).alias("precision"), rnd(recall).alias("recall"), rnd(f1).alias("f1"),
    )


_SWEEP_F1_CTES = f"""{_S},
{_grid_sql(ev.f1_grid())},
cm AS (SELECT threshold, count_if(p >= threshold AND y = 1) AS tp, count_if(p >= threshold AND y = 0) AS fp,
              count_if(p < threshold AND y = 1) AS fn, count_if(p < threshold AND y = 0) AS tn
       FROM grid CROSS JOIN s GROUP BY threshold),
sw AS (SELECT threshold, tp, fp, fn, tn,
              coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
              coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
              coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1 FROM cm)"""


@register(
    "threshold_sweep_f1",
    with_bookings(
        "SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sw",
        _SWEEP_F1_CTES,
    ),
)
def threshold_sweep_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 rows: precision / recall / F1 at the 19 thresholds 0.05…0.95 from one bucketed aggregation."""
    sw = ev.sweep_f1(_scored(spark, sf_dir), "p", "y")
    return sw.select("threshold", "tp", "fp", "fn", "tn", *[rnd(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register(
    "best_by_rule",
    with_bookings(
        """
SELECT 'best_by_f1' AS selection, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM (SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL
SELECT 'max_precision_given_recall', threshold, round(precision, 6), round(recall, 6), round(f1, 6)
FROM (SELECT * FROM sw WHERE recall >= 0.5 ORDER BY precision DESC, threshold LIMIT 1)
UNION ALL
SELECT 'max_recall_given_precision', threshold, round(precision, 6), round(recall, 6), round(f1, 6)
FROM (SELECT * FROM sw WHERE precision >= 0.33 ORDER BY recall DESC, threshold LIMIT 1)""",
        _SWEEP_F1_CTES,
    ),
)
def best_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 selection: best F1, max precision with recall ≥ 0.5, max recall with precision ≥ 0.33 (first threshold wins)."""
    sw = ev.sweep_f1(_scored(spark, sf_dir), "p", "y").cache()
    cols = ["threshold", rnd(F.col("precision")).alias("precision"), rnd(F.col("recall")).alias("recall"), rnd(F.col("f1")).alias("f1")]
    a = ev.best_rows(sw, "f1").select(F.lit("best_by_f1").alias("selection"), *cols)
    b = ev.best_by_rule(sw, "maximize_precision_given_recall", min_recall=0.5).select(F.lit("max_precision_given_recall").alias("selection"), *cols)
    c = ev.best_by_rule(sw, "maximize_recall_given_precision", min_precision=0.33).select(F.lit("max_recall_given_precision").alias("selection"), *cols)
    return a.unionByName(b).unionByName(c)


def _profit_cm(models_sql: str) -> str:
    return f"""{_S},
{_grid_sql(ev.profit_grid())},
ms AS ({models_sql}),
cm AS (SELECT model, threshold, count_if(p >= threshold AND y = 1) AS tp, count_if(p >= threshold AND y = 0) AS fp,
              count_if(p < threshold AND y = 1) AS fn, count_if(p < threshold AND y = 0) AS tn, count(*) AS n
       FROM grid CROSS JOIN ms GROUP BY ALL),
ps AS (SELECT model, threshold, tn, fp, fn, tp, coalesce((tp + fp) / nullif(CAST(n AS DOUBLE), 0), 0.0) AS action_rate,
              CAST(tp * 180.0 + fp * -20.0 + fn * -200.0 + tn * 0.0 AS DOUBLE) AS profit FROM cm)"""


_ONE_MODEL = "SELECT 'score' AS model, y, p FROM s"
_TWO_MODELS = "SELECT 'score' AS model, y, p FROM s UNION ALL SELECT 'lead_norm', y, CAST(lead_time AS DOUBLE) / 906.0 FROM s"


@register(
    "profit_sweep",
    with_bookings(
        "SELECT threshold, tn, fp, fn, tp, round(action_rate, 6) AS action_rate, round(profit, 6) AS profit FROM ps",
        _profit_cm(_ONE_MODEL),
    ),
)
def profit_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit at 999 thresholds (0.001 step) under the 180/−20/−200/0 cost matrix, no cross join."""
    sw = ev.profit_sweep(_scored(spark, sf_dir), "p", "y", COSTS)
    return sw.select("threshold", "tn", "fp", "fn", "tp", rnd(F.col("action_rate")).alias("action_rate"), rnd(F.col("profit")).alias("profit"))


@register(
    "profit_constrained",
    with_bookings(
        """
SELECT threshold, round(profit, 6) AS profit, round(action_rate, 6) AS action_rate, 'grid' AS strategy
FROM ps WHERE action_rate <= 0.1 ORDER BY profit DESC, threshold LIMIT 1""",
        _profit_cm(_ONE_MODEL),
    ),
)
def profit_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best profit among grid thresholds whose action rate ≤ 10 % (first threshold wins ties)."""
    out = ev.profit_constrained(_scored(spark, sf_dir), "p", "y", COSTS, 0.10)
    return out.select("threshold", rnd(F.col("profit")).alias("profit"), rnd(F.col("action_rate")).alias("action_rate"), "strategy")


_RATES_SQL = "rates AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3]) AS max_action_rate)"


@register(
    "quantile_threshold",
    with_bookings(
        """
SELECT q.max_action_rate, round(q.t, 6) AS threshold, count_if(s.p >= q.t) AS n_actions,
       round(count_if(s.p >= q.t) / CAST(count(*) AS DOUBLE), 6) AS action_rate,
       round(CAST(count_if(s.p >= q.t AND y = 1) * 180.0 + count_if(s.p >= q.t AND y = 0) * -20.0
             + count_if(s.p < q.t AND y = 1) * -200.0 AS DOUBLE), 6) AS profit
FROM q CROSS JOIN s GROUP BY ALL""",
        f"{_S},\nq AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3]) AS max_action_rate, "
        "unnest(quantile_cont(p, [0.95, 0.9, 0.85, 0.8, 0.7])) AS t FROM s)",
    ),
)
def quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threshold = exact linear quantile of score at 1 − rate for each capacity rate, with its action rate and profit."""
    s = _scored(spark, sf_dir)
    rates = list(DEFAULT_ACTION_RATES)
    qs = exact_quantiles(s, "p", [1.0 - r for r in rates])
    aggs = []
    for i, t in enumerate(qs):
        pred = F.col("p") >= F.lit(float(t))
        yy = F.col("y") == 1
        aggs += [F.count_if(pred).alias(f"a{i}"), F.count_if(pred & yy).alias(f"tp{i}"), F.count_if(pred & ~yy).alias(f"fp{i}"),
                 F.count_if(~pred & yy).alias(f"fn{i}")]
    row = s.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    out = []
    for i, (r, t) in enumerate(zip(rates, qs)):
        profit = row[f"tp{i}"] * COSTS.tp_value + row[f"fp{i}"] * COSTS.fp_value + row[f"fn{i}"] * COSTS.fn_value
        out.append((r, pround(t, 6), row[f"a{i}"], pround(row[f"a{i}"] / row["n"], 6), pround(float(profit), 6)))
    return spark.createDataFrame(out, "max_action_rate double, threshold double, n_actions long, action_rate double, profit double")


@register(
    "champion_policy",
    with_bookings(
        """
SELECT model, max_action_rate, threshold, round(profit, 6) AS profit, round(action_rate, 6) AS action_rate,
       row_number() OVER (ORDER BY profit DESC, CASE model WHEN 'lead_norm' THEN 0 WHEN 'score' THEN 1 ELSE 2 END, model) = 1 AS is_champion
FROM (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY profit DESC, max_action_rate, threshold) AS rk FROM (
          SELECT * FROM (
            SELECT ps.*, r.max_action_rate,
                   row_number() OVER (PARTITION BY ps.model, r.max_action_rate ORDER BY ps.profit DESC, ps.threshold) AS rr
            FROM ps JOIN rates r ON ps.action_rate <= r.max_action_rate) WHERE rr = 1)) WHERE rk = 1)""",
        _profit_cm(_TWO_MODELS) + ",\n" + _RATES_SQL,
    ),
)
def champion_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model × capacity rate best feasible profit threshold; best per model; champion by profit,
    ties by the preference list."""
    s = _scored(spark, sf_dir)
    sweeps = None
    for name, col in MODELS.items():
        sw = ev.profit_sweep(s.withColumn("p", col()), "p", "y", COSTS).withColumn("model", F.lit(name))
        sweeps = sw if sweeps is None else sweeps.unionByName(sw)
    # feasible rows per capacity rate: one filtered copy of the (models × grid)-row sweep per rate, no join
    feas = None
    for r in DEFAULT_ACTION_RATES:
        part = sweeps.where(F.col("action_rate") <= F.lit(float(r))).withColumn("max_action_rate", F.lit(float(r)))
        feas = part if feas is None else feas.unionByName(part)
    w1 = Window.partitionBy("model", "max_action_rate").orderBy(F.desc("profit"), "threshold")
    per_rate = feas.withColumn("rr", F.row_number().over(w1)).where("rr = 1")
    w2 = Window.partitionBy("model").orderBy(F.desc("profit"), "max_action_rate", "threshold")
    per_model = per_rate.withColumn("rk", F.row_number().over(w2)).where("rk = 1")
    pref = F.coalesce(*[F.when(F.col("model") == m, F.lit(i)) for i, m in enumerate(PREFER)], F.lit(len(PREFER)))
    w3 = Window.orderBy(F.desc("profit"), pref, "model")  # one row per model
    return per_model.select(
        "model", "max_action_rate", "threshold", rnd(F.col("profit")).alias("profit"), rnd(F.col("action_rate")).alias("action_rate"),
        (F.row_number().over(w3) == 1).alias("is_champion"),
    )


@register(
    "decide_threshold",
    with_bookings("SELECT booking_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS action FROM s", _S),
)
def decide_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """action = 1 when score ≥ 0.5, per booking."""
    out = decide_actions(_scored(spark, sf_dir), "p", "booking_id", 0.5)
    return out.select("booking_id", "action")


@register(
    "decide_capacity",
    with_bookings(
        """
SELECT booking_id, CASE WHEN NOT eligible THEN 0 WHEN CAST(ne AS DOUBLE) / n <= 0.1 THEN 1 WHEN rk <= k THEN 1 ELSE 0 END AS action
FROM (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY p DESC, booking_id) AS rk FROM e) r
CROSS JOIN (SELECT count(*) AS n, count_if(eligible) AS ne, CAST(floor(CAST(0.1 AS DOUBLE) * count(*)) AS BIGINT) AS k FROM e) c""",
        f"{_S},\ne AS (SELECT booking_id, p, coalesce(p >= 0.35, false) AS eligible FROM s)",
    ),
)
def decide_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score ≥ 0.35 is eligible; above a 10 % action rate keep the top ⌊0.1·n⌋ by score (key breaks ties)."""
    out = decide_actions(_scored(spark, sf_dir), "p", "booking_id", 0.35, max_action_rate=0.10)
    return out.select("booking_id", "action")


@register(
    "incremental_profit",
    with_bookings(
        """
SELECT booking_id, customer_type,
       round((p * CAST(coalesce(CASE customer_type WHEN '1-URGENT' THEN 230.0 WHEN '2-HIGH' THEN 190.0
                  WHEN '3-MEDIUM' THEN 170.0 WHEN '4-NOT SPECIFIED' THEN 150.0 END, 180.0) AS DOUBLE) + (1.0 - p) * CAST(-20.0 AS DOUBLE))
             - (p * CAST(-200.0 AS DOUBLE) + (1.0 - p) * CAST(0.0 AS DOUBLE)), 6) AS uplift_score
FROM s""",
        _S,
    ),
)
def incremental_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected incremental profit of acting, with the true-positive value looked up by segment."""
    s = _scored(spark, sf_dir)
    u = incremental_profit_score(F.col("p"), COSTS, F.col("customer_type"), PROXY_SEGMENT_TP)
    return s.select("booking_id", "customer_type", rnd(u).alias("uplift_score"))


_EDGES = [float(v) for v in np.linspace(0.0, 1.0, 11)]
_EDGE_LIST = "[" + ", ".join(repr(v) for v in _EDGES) + "]"
_INNER_LIST = "[" + ", ".join(repr(v) for v in _EDGES[1:-1]) + "]"
_REL_CTES = f"""{_S},
edges AS (SELECT CAST(i AS INTEGER) AS bin, {_EDGE_LIST}[i + 1] AS "left", {_EDGE_LIST}[i + 2] AS "right" FROM range(0, 10) t(i)),
rb AS (SELECT CAST(len(list_filter({_INNER_LIST}, lambda e: e <= p)) AS INTEGER) AS bin, p, y FROM s WHERE p >= 0.0 AND p <= 1.0)"""


@register(
    "reliability_table",
    with_bookings(
        """
SELECT e.bin, e."left", e."right", count(rb.p) AS count, round(avg(rb.p), 6) AS avg_pred, round(avg(CAST(rb.y AS DOUBLE)), 6) AS empirical_rate
FROM edges e LEFT JOIN rb ON rb.bin = e.bin GROUP BY ALL""",
        _REL_CTES,
    ),
)
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 equal-width score bins (last closed) with count, mean score and observed rate; empty bins kept."""
    t = ev.reliability_table(_scored(spark, sf_dir), "p", "y", 10, close_last=True)
    return t.select("bin", "left", "right", "count", rnd(F.col("avg_pred")).alias("avg_pred"), rnd(F.col("empirical_rate")).alias("empirical_rate"))


@register(
    "ece",
    with_bookings(
        """
SELECT round(coalesce(sum(cnt / CAST((SELECT count(*) FROM s) AS DOUBLE) * abs(ap - er)), 0.0), 6) AS ece
FROM (SELECT bin, count(*) AS cnt, avg(p) AS ap, avg(CAST(y AS DOUBLE)) AS er
      FROM rb WHERE p < 1.0 GROUP BY 1)""",
        _REL_CTES,
    ),
)
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over 10 bins (last bin half-open, so p = 1.0 is left out)."""
    return ev.expected_calibration_error(_scored(spark, sf_dir), "p", "y", 10).select(rnd(F.col("ece")).alias("ece"))


@register(
    "brier_logloss",
    with_bookings(
        """
SELECT round(avg(pow(p - y, 2)), 6) AS brier,
       round(avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6) AS log_loss,
       count(*) AS n
FROM s""",
        _S,
    ),
)
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and log loss (clip 1e-15) of score vs y."""
    out = ev.brier_logloss(_scored(spark, sf_dir), "p", "y")
    return out.select(rnd(F.col("brier")).alias("brier"), rnd(F.col("log_loss")).alias("log_loss"), "n")


_CURVE_CTES = f"""{_S},
g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g),
t AS (SELECT sum(pos) AS tot_pos, sum(neg) AS tot_neg FROM g)"""


@register(
    "roc_curve",
    with_bookings("SELECT p AS threshold, round(fp / CAST(tot_neg AS DOUBLE), 6) AS fpr, round(tp / CAST(tot_pos AS DOUBLE), 6) AS tpr FROM c, t", _CURVE_CTES),
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC points (fpr, tpr) at every distinct score, from global prefix sums of grouped scores."""
    out = ev.roc_curve(_scored(spark, sf_dir), "p", "y")
    return out.select("threshold", rnd(F.col("fpr")).alias("fpr"), rnd(F.col("tpr")).alias("tpr"))


@register(
    "pr_curve",
    with_bookings(
        "SELECT p AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tot_pos AS DOUBLE), 6) AS recall FROM c, t",
        _CURVE_CTES,
    ),
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """precision–recall points at every distinct score (highest first)."""
    out = ev.pr_curve(_scored(spark, sf_dir), "p", "y")
    return out.select("threshold", rnd(F.col("precision")).alias("precision"), rnd(F.col("recall")).alias("recall"))
