"""Named queries for scoring and decisioning (C10–C14, flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.functions.scalar import rnd
from driftwise.operators.anomaly import tag_row_anomalies
from driftwise.operators.policy import CostMatrix, DecisionPolicy, score_and_decide
from driftwise.sources.tables import bookings

# Query parameters for the bookings proxy: its ``customer_type`` holds order
# priorities, so the per-segment true-positive values are keyed by those.
PROXY_SEGMENT_TP = {"1-URGENT": 230.0, "2-HIGH": 190.0, "3-MEDIUM": 170.0, "4-NOT SPECIFIED": 150.0}
FLAGSHIP_POLICY = DecisionPolicy(
    threshold=0.35,
    max_action_rate=0.30,
    ranking_mode="incremental_profit",
    segment_col="customer_type",
    tp_value_by_segment=PROXY_SEGMENT_TP,
    costs=CostMatrix(),
    model_used="score",
)

_SEG_CASE = (
    "CASE customer_type WHEN '1-URGENT' THEN 230.0 WHEN '2-HIGH' THEN 190.0 "
    "WHEN '3-MEDIUM' THEN 170.0 WHEN '4-NOT SPECIFIED' THEN 150.0 END"
)

# decided rows: proba, uplift, eligibility, capacity rank, action
_DECIDE_CTES = f"""
s AS (SELECT *, LEAST(GREATEST(COALESCE(CASE WHEN isnan(score) THEN 0.5 ELSE score END, 0.5), 0.0), 1.0) AS proba
      FROM bookings),
u AS (SELECT *, (proba * CAST(COALESCE({_SEG_CASE}, 180.0) AS DOUBLE) + (1.0 - proba) * CAST(-20.0 AS DOUBLE))
               - (proba * CAST(-200.0 AS DOUBLE) + (1.0 - proba) * CAST(0.0 AS DOUBLE)) AS uplift_score
      FROM s),
e AS (SELECT *, COALESCE(proba >= CAST(0.35 AS DOUBLE) AND uplift_score > 0.0, false) AS eligible FROM u),
c AS (SELECT count(*) AS n, count_if(eligible) AS ne,
             CAST(floor(CAST(0.3 AS DOUBLE) * count(*)) AS BIGINT) AS k FROM e),
r AS (SELECT e.*, row_number() OVER (PARTITION BY eligible ORDER BY uplift_score DESC, booking_id) AS rk FROM e),
a AS (SELECT r.*, CASE WHEN NOT eligible THEN 0
                       WHEN CAST(c.ne AS DOUBLE) / c.n <= CAST(0.3 AS DOUBLE) THEN 1
                       WHEN rk <= c.k THEN 1 ELSE 0 END AS action
      FROM r CROSS JOIN c)
"""


def realised_value(action, y, costs: CostMatrix = CostMatrix()):
    return (
        F.when((action == 1) & (y == 1), F.lit(costs.tp_value))
        .when((action == 1) & (y == 0), F.lit(costs.fp_value))
        .when((action == 0) & (y == 1), F.lit(costs.fn_value))
        .otherwise(F.lit(costs.tn_value))
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings → row-anomaly tags → score → uplift (C13) → threshold + capacity
    → per-segment actions, expected and realised profit."""
    tagged = tag_row_anomalies(bookings(spark, sf_dir))
    decided = score_and_decide(tagged, "score", "booking_id", FLAGSHIP_POLICY)
    a, y = F.col("action"), F.col("y")
    return decided.groupBy("customer_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(a).cast("long").alias("n_actions"),
        rnd(F.avg(a)).alias("action_rate"),
        rnd(F.sum(F.when(a == 1, F.col("uplift_score")).otherwise(F.lit(0.0)))).alias("expected_profit"),
        rnd(F.sum(realised_value(a, y))).alias("realised_profit"),
        F.count_if(F.size("anomaly_types") > 0).alias("n_anomalous"),
    )


FLAGSHIP_SQL = with_bookings(
    """
SELECT customer_type,
       count(*) AS n_rows,
       CAST(sum(action) AS BIGINT) AS n_actions,
       round(avg(action), 6) AS action_rate,
       round(sum(CASE WHEN action = 1 THEN uplift_score ELSE 0.0 END), 6) AS expected_profit,
       round(sum(CASE WHEN action = 1 AND y = 1 THEN 180.0 WHEN action = 1 AND y = 0 THEN -20.0
                      WHEN action = 0 AND y = 1 THEN -200.0 ELSE 0.0 END), 6) AS realised_profit,
       count_if(coalesce(adults, 0) = 0 AND coalesce(children, 0) = 0 AND coalesce(babies, 0) = 0
                OR adr < -10 OR stays_in_weekend_nights + stays_in_week_nights > 365
                OR lead_time > 800 OR adults > 50) AS n_anomalous
FROM a GROUP BY customer_type
""",
    _DECIDE_CTES,
)

register("score_and_decide", FLAGSHIP_SQL)(flagship)


@register(
    "actions_table",
    with_bookings(
        """
SELECT booking_id, proba, action, CAST(0.35 AS DOUBLE) AS threshold_used, CAST(0.3 AS DOUBLE) AS max_action_rate_used,
       'score' AS model_used, 'run-cur' AS run_id
FROM a WHERE period = 'cur'""",
        _DECIDE_CTES.replace("FROM bookings),", "FROM bookings WHERE period = 'cur'),", 1),
    ),
    materialize=True,
)
def actions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current-period decisions (proba, action, threshold, capacity, model) with the booking key,
    written to an actions table partitioned by run id and read back."""
    from driftwise.sources.files import scratch_path, write_actions

    cur = bookings(spark, sf_dir).where(F.col("period") == "cur")
    decided = score_and_decide(cur, "score", "booking_id", FLAGSHIP_POLICY)
    path = scratch_path(spark, "actions")
    write_actions(decided.select("booking_id", "proba", "action", "threshold_used", "max_action_rate_used", "model_used"), path, "run-cur")
    return spark.read.parquet(path).select("booking_id", "proba", "action", "threshold_used", "max_action_rate_used", "model_used", "run_id")
