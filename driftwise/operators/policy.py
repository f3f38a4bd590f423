"""Decisioning: probability → action under a threshold, an uplift gate and a capacity.

All rules are Column expressions over a keyed DataFrame.  The capacity rule
(keep the top ⌊rate·n⌋ eligible rows by ranking score) is an exact filter built
by ``plans.ordering.top_k_predicate``: ties on the score are broken by key
ascending, which makes the result deterministic (the reference leaves ties to
``argpartition``).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.scalar import map_lookup
from driftwise.plans.ordering import top_k_predicate


# The reference's default cost matrix (USD per outcome) and
# per-segment true-positive values for incremental-profit ranking.
DEFAULT_COSTS = {"tp_value": 180.0, "fp_value": -20.0, "fn_value": -200.0, "tn_value": 0.0}
DEFAULT_SEGMENT_TP = {"Contract": 230.0, "Group": 150.0, "Transient": 170.0, "Transient-Party": 190.0}
DEFAULT_ACTION_RATES = (0.05, 0.10, 0.15, 0.20, 0.30)


def _inside(x: float, name: str, top_open: bool = False) -> None:
    if not 0.0 < x <= 1.0 or (top_open and x == 1.0):
        raise ValueError(f"{name} = {x} lies outside (0, 1{')' if top_open else ']'}")


@dataclass(frozen=True)
class CostMatrix:
    tp_value: float = 180.0
    fp_value: float = -20.0
    fn_value: float = -200.0
    tn_value: float = 0.0


@dataclass(frozen=True)
class DecisionPolicy:
    threshold: float
    max_action_rate: float | None = None
    ranking_mode: str = "proba"  # "proba" | "incremental_profit"
    segment_col: str | None = None
    tp_value_by_segment: Mapping[str, float] = field(default_factory=dict)
    costs: CostMatrix = CostMatrix()
    model_used: str = "baseline"

    def __post_init__(self):
        _inside(self.threshold, "threshold", top_open=True)
        if self.max_action_rate is not None:
            _inside(self.max_action_rate, "max_action_rate")


def profit_from_confusion(tp, fp, fn, tn, costs: CostMatrix = CostMatrix()):
    """Profit of a confusion matrix; works on numbers or Columns."""
    return tp * costs.tp_value + fp * costs.fp_value + fn * costs.fn_value + tn * costs.tn_value


def incremental_profit_score(
    p: Column,
    costs: CostMatrix,
    segment: Column | None = None,
    tp_by_segment: Mapping[str, float] | None = None,
) -> Column:
    """p·tp + (1−p)·fp − (p·fn + (1−p)·tn), tp looked up by segment."""
    tp = F.lit(float(costs.tp_value))
    if segment is not None and tp_by_segment:
        tp = F.coalesce(map_lookup(tp_by_segment, segment.cast("string")), tp)
    act = p * tp + (F.lit(1.0) - p) * F.lit(float(costs.fp_value))
    no_act = p * F.lit(float(costs.fn_value)) + (F.lit(1.0) - p) * F.lit(float(costs.tn_value))
    return act - no_act


def clamp_proba(p: Column) -> Column:
    """NaN/NULL → 0.5, then clip to [0, 1]."""
    filled = F.coalesce(F.nanvl(p.cast("double"), F.lit(0.5)), F.lit(0.5))
    return F.least(F.greatest(filled, F.lit(0.0)), F.lit(1.0))


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def eligibility(proba_col: str, threshold: float, ranking_col: str | None = None) -> Column:
    """A known probability at or above the threshold and, if ranked by gain, a known positive gain."""
    _inside(threshold, "threshold", top_open=True)
    rules = [_number(F.col(proba_col)), F.col(proba_col) >= F.lit(float(threshold))]
    if ranking_col is not None:
        rules += [_number(F.col(ranking_col)), F.col(ranking_col) > F.lit(0.0)]
    return F.coalesce(functools.reduce(lambda a, b: a & b, rules), F.lit(False))


def decide_actions(
    df: DataFrame,
    proba_col: str,
    key_col: str,
    threshold: float,
    max_action_rate: float | None = None,
    ranking_col: str | None = None,
    out_col: str = "action",
) -> DataFrame:
    """Adds ``out_col`` (int 0/1), one predicate over the row.

    Beyond the capacity only the best ⌊rate · n⌋ eligible rows act (ranking score descending, key ascending); the
    cut-off is found first and becomes part of the predicate, so nothing is joined back.
    """
    act = eligibility(proba_col, threshold, ranking_col)
    if max_action_rate is not None:
        _inside(max_action_rate, "max_action_rate")
        seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(act).alias("eligible")).first()
        room = int(math.floor(float(max_action_rate) * seen["rows"]))  # floor of the double product
        if seen["rows"] and seen["eligible"] / seen["rows"] > max_action_rate:
            act = act & top_k_predicate(df.where(act), ranking_col or proba_col, key_col, room)
    return df.withColumn(out_col, act.cast("int"))


def score_and_decide(df: DataFrame, proba_col: str, key_col: str, policy: DecisionPolicy) -> DataFrame:
    """C14 core: clamp → optional uplift score → actions → output columns (S13 shape + key)."""
    work = df.withColumn("proba", clamp_proba(F.col(proba_col)))
    ranking_col = None
    if policy.ranking_mode == "incremental_profit":
        seg = F.col(policy.segment_col) if policy.segment_col else None
        work = work.withColumn(
            "uplift_score", incremental_profit_score(F.col("proba"), policy.costs, seg, policy.tp_value_by_segment)
        )
        ranking_col = "uplift_score"
    work = decide_actions(work, "proba", key_col, policy.threshold, policy.max_action_rate, ranking_col)
    return (
        work.withColumn("threshold_used", F.lit(float(policy.threshold)))
        .withColumn(
            "max_action_rate_used",
            F.lit(float(policy.max_action_rate) if policy.max_action_rate is not None else None).cast("double"),
        )
        .withColumn("model_used", F.lit(policy.model_used))
    )
