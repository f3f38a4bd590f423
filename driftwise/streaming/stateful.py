"""Order-dependent event processors (R1–R3) over event tables.

* ``login_guard`` (R3) is expressed without per-key state: failures in the
  window since the last success are running counts (grouped prefix sums over
  range buckets) minus an as-of lookup, so a user with a third of all events is
  still spread over many tasks.
* ``throttle_audit`` (R1/R2) is genuinely sequential — whether an event is
  accepted depends on earlier acceptances.  Each key's timeline is cut where
  the idle gap exceeds the window (the limiter state is provably empty there),
  and the pieces run in parallel through ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.plans.ordering import global_prefix_sum, grouped_rank

# Login-guard parameters of the reference (window, backoff start, base, max, lockout).
BACKOFF_START = 3
BASE_BACKOFF_SECONDS = 2
MAX_BACKOFF_SECONDS = 120
LOCKOUT_AFTER = 8
LOCKOUT_SECONDS = 900


def window_failure_counts(
    events: DataFrame, key: str, t_col: str, id_col: str, is_failure: str, is_success: str | None, window_us: int
) -> DataFrame:
    """Per failure event: failures of the same key in [t − window, t] that follow the key's last success.

    Running failure counts and the count at the last success come from grouped
    prefix sums / maxima; "failures before t − window" is read off probe rows
    merged into the same ordered stream (probes sort before events at equal time).
    """
    base = events.select(key, t_col, id_col, F.col(is_failure).cast("long").alias("_f"),
                         (F.col(is_success).cast("long") if is_success else F.lit(0).cast("long")).alias("_s"))
    base = base.where((F.col("_f") == 1) | (F.col("_s") == 1))
    probes = base.where(F.col("_f") == 1).select(
        key, (F.col(t_col) - F.lit(window_us)).alias(t_col), F.col(id_col).alias("_probe_of"), F.lit(0).cast("long").alias("_f"),
        F.lit(0).cast("long").alias("_s"), F.lit(0).alias("_tb"),
    )
    rows = base.select(key, t_col, F.lit(None).cast(base.schema[id_col].dataType).alias("_probe_of"), "_f", "_s", F.lit(1).alias("_tb"),
                       F.col(id_col).alias("_eid"))
    merged = rows.unionByName(probes.withColumn("_eid", F.col("_probe_of")), allowMissingColumns=False)
    run = global_prefix_sum(merged, t_col, ["_f"], group_cols=[key], tiebreak=["_tb", "_eid"])
    run = run.withColumn("_succ_cum", F.when(F.col("_s") == 1, F.col("cum__f")))
    run = global_prefix_sum(run, t_col, ["_succ_cum"], group_cols=[key], tiebreak=["_tb", "_eid"], how="max", prefix="last")
    ev = run.where((F.col("_tb") == 1) & (F.col("_f") == 1)).select(
        key, F.col("_eid").alias(id_col), t_col, F.col("cum__f").alias("_cum"), F.coalesce(F.col("last_succ_cum"), F.lit(0)).alias("_last_s")
    )
    pr = run.where(F.col("_tb") == 0).select(F.col("_probe_of").alias(id_col), F.col("cum__f").alias("_before"))
    j = ev.join(pr, id_col)
    n = F.col("_cum") - F.greatest(F.col("_before"), F.col("_last_s"))
    return j.select(key, id_col, t_col, n.alias("failures"))


def penalty(n):
    """(state, retry_after seconds) for a failure count — works on Columns."""
    backoff = F.least(F.lit(MAX_BACKOFF_SECONDS), F.lit(BASE_BACKOFF_SECONDS) * F.pow(F.lit(2), n - BACKOFF_START).cast("long"))
    state = F.when(n >= LOCKOUT_AFTER, F.lit("lockout")).when(n >= BACKOFF_START, F.lit("backoff")).otherwise(F.lit("none"))
    wait = F.when(n >= LOCKOUT_AFTER, F.lit(LOCKOUT_SECONDS)).when(n >= BACKOFF_START, backoff).otherwise(F.lit(0)).cast("long")
    return state, wait


def login_guard(events: DataFrame, id_col: str, user_col: str, ip_col: str, t_col: str, is_failure: str, is_success: str, window_us: int) -> DataFrame:
    """Per failure, user-scope and ip-scope failure counts (success clears the user scope only),
    penalty state (lockout ≥ 8, backoff ≥ 3 with min(120, 2·2^(n−3)) s) and the retry-after of the worse scope."""
    u = window_failure_counts(events, user_col, t_col, id_col, is_failure, is_success, window_us).select(id_col, F.col("failures").alias("user_failures"))
    i = window_failure_counts(events, ip_col, t_col, id_col, is_failure, None, window_us).select(id_col, F.col("failures").alias("ip_failures"))
    return with_penalty(u.join(i, id_col), id_col)


def with_penalty(counts: DataFrame, id_col: str) -> DataFrame:
    """Penalty state and retry-after from ``user_failures`` and ``ip_failures``; the worse scope decides."""
    us, uw = penalty(F.col("user_failures"))
    is_, iw = penalty(F.col("ip_failures"))
    state = F.when((us == "lockout") | (is_ == "lockout"), F.lit("lockout")).when((us == "backoff") | (is_ == "backoff"), F.lit("backoff")).otherwise(F.lit("none"))
    return counts.select(id_col, "user_failures", "ip_failures", state.alias("penalty_state"), F.greatest(uw, iw).alias("retry_after_seconds"))


# ------------------------------------------------------------------ R1 / R2 throttle


def _limiter(limit: int, window_us: int, inclusive: bool):
    """pandas function: walk one key-segment in time order, accept while < limit accepted stamps in the window.

    ``inclusive`` keeps stamps exactly one window old (R1); the Lua variant evicts them (R2).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="mergesort")
        ts = pdf["t"].to_numpy()
        accepted = np.zeros(len(ts), dtype=bool)
        window: list[int] = []
        head = 0
        for i, t in enumerate(ts):
            lo = t - window_us
            while head < len(window) and (window[head] < lo if inclusive else window[head] <= lo):
                head += 1
            if len(window) - head < limit:
                window.append(int(t))
                accepted[i] = True
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "allowed": accepted})

    return run


def throttle_audit(events: DataFrame, key: str, t_col: str, id_col: str, limit: int, window_us: int, inclusive: bool = True) -> DataFrame:
    """Allowed flag per event of a sliding-window limiter (refused events do not count)."""
    ranked = grouped_rank(events.select(key, t_col, id_col), [key], t_col, id_col, out="_r")
    prev = ranked.select(key, (F.col("_r") + 1).alias("_r"), F.col(t_col).alias("_prev_t"))
    gap = ranked.join(prev, [key, "_r"], "left")
    # a gap longer than the window (or equal, when stamps that old are evicted) empties the limiter
    brk = (F.col("_prev_t").isNull() | ((F.col(t_col) - F.col("_prev_t")) > window_us if inclusive else (F.col(t_col) - F.col("_prev_t")) >= window_us))
    flagged = gap.withColumn("_brk", brk.cast("long"))
    seg = global_prefix_sum(flagged, "_r", ["_brk"], group_cols=[key], prefix="seg")
    pieces = seg.select(F.col(key).alias("k"), F.col("seg_brk").alias("seg"), F.col(t_col).alias("t"), F.col(id_col).alias("id"))
    out = pieces.groupBy("k", "seg").applyInPandas(_limiter(limit, window_us, inclusive), schema=f"id {dict(pieces.dtypes)['id']}, allowed boolean")
    return out.withColumnRenamed("id", id_col)
