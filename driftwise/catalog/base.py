"""Registry of named queries: a Spark job plus, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


# Multi-pass jobs over the bookings view (several Spark jobs each): they read it from a table written once.
MULTI_PASS = {
    "score_and_decide", "outcome_report", "build_alerts", "validation_profile", "monitoring_report", "run_snapshot",
    "distribution_check", "correlation_drift", "serving_skew", "importance_drift", "data_drift_report", "prediction_drift",
    "label_drift", "ks_stat", "binary_metrics", "roc_auc_exact", "quantile_threshold", "champion_policy", "decide_capacity",
    "profit_constrained", "best_by_rule", "roc_curve", "pr_curve", "preprocess_basic", "impute_median_mode", "standardise",
    "one_hot_counts", "frequency_encode", "stratified_split", "three_way_split", "row_count_reconcile", "kfold_assign",
    "reference_stats", "reference_correlations", "value_counts_topn", "histogram_fixed", "model_health", "rollback_matrix",
    "lineage_record", "dead_letter", "correlated_alert", "null_ratio_report", "record_constraints",
}


def register(name: str, sql: str | None = None, materialize: bool | None = None):
    """Register a named query.  ``materialize=True`` marks a multi-pass job: the bookings view is written once
    to the shared scratch folder and every pass of the job reads that table."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        run = fn
        if materialize or (materialize is None and name in MULTI_PASS):
            from driftwise.sources.tables import materialized_bookings

            @functools.wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                with materialized_bookings(spark, sf_dir):
                    return fn(spark, sf_dir)

        REGISTRY[name] = Entry(name, run, bigint_counts(sql.strip()) if sql else None, (fn.__doc__ or "").strip())
        return run

    return deco


def bigint_counts(sql: str) -> str:
    """Rewrite ``count_if(x)`` as ``count(*) FILTER (WHERE x)`` so the SQL twin returns BIGINT counts
    (DuckDB's ``count_if`` is a 128-bit integer, which changes the result's column type)."""
    out = []
    i = 0
    token = "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(token)
        while depth:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            k += 1
        inner = bigint_counts(sql[j + len(token):k - 1])
        out.append(f"count(*) FILTER (WHERE {inner})")
        i = k


# The bookings proxy view as a DuckDB CTE (same text runs in Spark SQL).
BOOKINGS_CTE = """
bookings AS (
  WITH li AS (
    SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, sum(l_extendedprice) AS price,
           max(l_linenumber) AS max_line,
           sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
    FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey AS booking_id,
         CAST(o_orderdate AS DATE) AS booked_on,
         CASE WHEN o_orderdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'ref' ELSE 'cur' END AS period,
         CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS is_canceled,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'Resort Hotel' ELSE 'City Hotel' END AS hotel,
         year(o_orderdate) AS arrival_date_year,
         substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3) AS arrival_date_month,
         day(o_orderdate) AS arrival_date_day_of_month,
         CAST((o_orderkey * 37) % 907 AS INT) AS lead_time,
         CAST(li.n_lines AS INT) AS adults,
         CAST(li.n_ret AS INT) AS children,
         CAST(li.max_line % 2 AS INT) AS babies,
         CAST((o_orderkey * 13) % 11 AS INT) AS stays_in_week_nights,
         CAST((o_orderkey * 7) % 4 AS INT) AS stays_in_weekend_nights,
         li.price / li.qty AS adr,
         n_name AS country, c_mktsegment AS market_segment, o_orderpriority AS customer_type,
         CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS score
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN li ON l_orderkey = o_orderkey)
"""


def with_bookings(body: str, ctes: str = "") -> str:
    """Oracle SQL over the bookings proxy: ``WITH bookings AS (...), <ctes> <body>``."""
    extra = f",\n{ctes.strip()}" if ctes.strip() else ""
    return f"WITH {BOOKINGS_CTE.strip()}{extra}\n{body.strip()}"
