"""Drift between a reference and a current DataFrame.

Numeric PSI / JS for *all* columns runs on one long-form table
(column_name, side, value): joint min/max per column (one aggregation, one row
per column), bins by an exact edge expression, counts per (column, bin, side)
(one aggregation), then the divergence per column — a fixed number of jobs
whatever the column count.  KS uses the global prefix sum, never a one-task
window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise.functions.scalar import rnd, to_double
from driftwise.operators.profile import pair_correlations, uniform_bin
from driftwise.plans.ordering import global_prefix_sum

PSI_EPS = 1e-8
SHARE_EPS = 1e-9


_EXACT_TYPES = {"tinyint", "smallint", "int", "bigint", "double"}


def _sided_long(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    def one(df: DataFrame, side: str) -> DataFrame:
        types = dict(df.dtypes)
        # whole numbers and doubles are what their text would parse to
        parsed = df.select(*[to_double(F.col(f"`{c}`") if types[c] in _EXACT_TYPES else F.col(f"`{c}`").cast("string")).alias(c) for c in cols])
        casts = ", ".join(f"'{c}', `{c}`" for c in cols)
        long = parsed.selectExpr(f"stack({len(cols)}, {casts}) AS (column_name, value)")
        return long.select("column_name", F.lit(side).alias("side"), "value").where(
            F.col("value").isNotNull()
        )

    return one(ref, "ref").unionByName(one(cur, "cur"))


def binned_counts(ref: DataFrame, cur: DataFrame, cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(column_name, bin, n_ref, n_cur, tot_ref, tot_cur, constant) on shared equal-width bins.

    Every bin of every column is present (zero-filled) so divergences sum over
    the full grid.  Columns whose joint range is a single value are flagged
    ``constant`` (their divergence is 0 by definition).
    """
    long = _sided_long(ref, cur, cols)
    ranges = long.groupBy("column_name").agg(
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count_if(F.col("side") == "ref").alias("tot_ref"),
        F.count_if(F.col("side") == "cur").alias("tot_cur"),
    )
    # one row per column: a bounded broadcast
    step = (F.col("hi") - F.col("lo")) / F.lit(float(n_bins))
    ranged = long.join(F.broadcast(ranges), "column_name").where(F.col("hi") > F.col("lo"))
    binned = ranged.select(
        "column_name", "side", uniform_bin(F.col("value"), F.col("lo"), step, n_bins).alias("bin")
    )
    counts = binned.groupBy("column_name", "bin").agg(
        F.count_if(F.col("side") == "ref").alias("n_ref"), F.count_if(F.col("side") == "cur").alias("n_cur")
    )
    grid = ranges.select(
        "column_name", "tot_ref", "tot_cur", (F.col("hi") <= F.col("lo")).alias("constant"),
        F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"),
    )
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin",
        F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_cur", F.lit(0)).alias("n_cur"),
        "tot_ref", "tot_cur", "constant",
    )


def divergence(counts: DataFrame, n_bins: int = 10, metric: str = "psi") -> DataFrame:
    """(column_name, score, n_ref, n_cur) from ``binned_counts``; X3: metric is 'psi' or 'js'."""
    e = (F.col("n_ref") + F.lit(PSI_EPS)) / (F.col("tot_ref") + F.lit(PSI_EPS * n_bins))
    a = (F.col("n_cur") + F.lit(PSI_EPS)) / (F.col("tot_cur") + F.lit(PSI_EPS * n_bins))
    if metric == "psi":
        term = (a - e) * F.log(a / e)
    elif metric == "js":
        m = F.lit(0.5) * (e + a)
        term = e * F.log2(e / m) + a * F.log2(a / m)
    else:
        raise ValueError(f"unknown drift metric {metric!r}")
    agg = counts.groupBy("column_name").agg(
        F.sum(term).alias("s"), F.first("tot_ref").alias("n_ref"), F.first("tot_cur").alias("n_cur"),
        F.first("constant").alias("constant"),
    )
    score = F.col("s") if metric == "psi" else F.least(F.greatest(F.lit(0.5) * F.col("s"), F.lit(0.0)), F.lit(1.0))
    return agg.select(
        "column_name", F.when(F.col("constant"), F.lit(0.0)).otherwise(score).alias("score"), "n_ref", "n_cur"
    )


def drift_scores(
    ref: DataFrame,
    cur: DataFrame,
    cols: Sequence[str],
    n_bins: int = 10,
    metric: str = "psi",
    warn: float = 0.10,
    block: float = 0.25,
    column_thresholds: Mapping[str, float] | None = None,
    critical: Sequence[str] = (),
    min_values: int = 5,
) -> DataFrame:
    """Per column score and status (stable / warn / drift); columns with < min_values per side skipped.

    A per-column override sets warn *and* block to the same number; a critical
    column's block threshold drops to its warn threshold.
    """
    cols = [c for c in cols if c in ref.columns and c in cur.columns]
    scores = divergence(binned_counts(ref, cur, cols, n_bins), n_bins, metric)
    scores = scores.where((F.col("n_ref") >= min_values) & (F.col("n_cur") >= min_values))
    overrides = dict(column_thresholds or {})
    warn_c = F.lit(float(warn))
    block_c = F.lit(float(block))
    for c, t in overrides.items():
        warn_c = F.when(F.col("column_name") == c, F.lit(float(t))).otherwise(warn_c)
        block_c = F.when(F.col("column_name") == c, F.lit(float(t))).otherwise(block_c)
    if critical:
        block_c = F.when(F.col("column_name").isin(list(critical)), warn_c).otherwise(block_c)
    status = F.when(F.col("score") >= block_c, "drift").when(F.col("score") >= warn_c, "warn").otherwise("stable")
    return scores.select("column_name", rnd(F.col("score")).alias("score"), status.alias("status"))


def categorical_psi(ref: DataFrame, cur: DataFrame, cols: Sequence[str], null_label: str = "<NA>") -> DataFrame:
    """PSI on category shares over the union of categories; clip 1e-9, renormalise; NULL is a category.

    Per-column totals are grouped (one row per column) and broadcast back, so a
    column with many categories never lands in a single window partition.
    """

    def counts(df: DataFrame, side: str) -> DataFrame:
        casts = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
        long = df.selectExpr(f"stack({len(cols)}, {casts}) AS (column_name, value)").withColumn(
            "value", F.coalesce("value", F.lit(null_label))
        )
        return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias(f"n_{side}"))

    both = counts(ref, "ref").join(counts(cur, "cur"), ["column_name", "value"], "full_outer").fillna(0, ["n_ref", "n_cur"])
    tot = both.groupBy("column_name").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    shares = both.join(F.broadcast(tot), "column_name").select(
        "column_name",
        F.greatest(F.coalesce(F.try_divide(F.col("n_ref").cast("double"), F.col("t_ref")), F.lit(0.0)), F.lit(SHARE_EPS)).alias("r"),
        F.greatest(F.coalesce(F.try_divide(F.col("n_cur").cast("double"), F.col("t_cur")), F.lit(0.0)), F.lit(SHARE_EPS)).alias("c"),
    )
    norm = shares.groupBy("column_name").agg(F.sum("r").alias("sr"), F.sum("c").alias("sc"))
    j = shares.join(F.broadcast(norm), "column_name").select(
        "column_name", (F.col("r") / F.col("sr")).alias("r"), (F.col("c") / F.col("sc")).alias("c")
    )
    return j.groupBy("column_name").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def ks_statistic(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Max |F_ref − F_cur| over the union of points, from running counts (global prefix sum)."""
    r = ref.select(to_double(F.col(col)).alias("x")).where(F.col("x").isNotNull())
    c = cur.select(to_double(F.col(col)).alias("x")).where(F.col("x").isNotNull())
    pts = r.select("x", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        c.select("x", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    grouped = pts.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = pts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).first()
    na, nb = totals["na"] or 0, totals["nb"] or 0
    spark = ref.sparkSession
    if na + nb == 0:
        return spark.createDataFrame([(0.0,)], "ks_stat double")
    run = global_prefix_sum(grouped, "x", ["a", "b"])
    diff = F.abs(F.col("cum_a") / F.lit(float(max(na, 1))) - F.col("cum_b") / F.lit(float(max(nb, 1))))
    return run.agg(F.coalesce(F.max(diff), F.lit(0.0)).alias("ks_stat"))


def safe_hist_shares(df: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """Shares over fixed edges (last bin closed, outside ignored), clip 1e-9, renormalise; empty → uniform."""
    n_bins = len(edges) - 1
    lo, hi = float(edges[0]), float(edges[-1])
    step = (hi - lo) / n_bins
    x = to_double(F.col(col))
    inside = df.select(x.alias("x")).where((F.col("x") >= lo) & (F.col("x") <= hi))
    counts = inside.groupBy(uniform_bin(F.col("x"), F.lit(lo), F.lit(step), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # n_bins rows only
    tot = F.sum("n").over(w)
    p = F.when(tot <= 0, F.lit(1.0 / n_bins)).otherwise(F.col("n") / tot)
    clipped = full.select("bin", F.greatest(p, F.lit(SHARE_EPS)).alias("p"))
    return clipped.select("bin", (F.col("p") / F.sum("p").over(w)).alias("p"))


def prediction_drift(ref: DataFrame, cur: DataFrame, col: str, n_bins: int = 10) -> DataFrame:
    """PSI on [0,1] with fixed bins, KS statistic and mean probabilities, one row."""
    edges = [i / n_bins for i in range(n_bins + 1)]
    pr = safe_hist_shares(ref, col, edges).withColumnRenamed("p", "pr")
    pc = safe_hist_shares(cur, col, edges).withColumnRenamed("p", "pc")
    psi = pr.join(pc, "bin").agg(F.sum((F.col("pc") - F.col("pr")) * F.log(F.col("pc") / F.col("pr"))).alias("psi")).first()[0]
    ks = ks_statistic(ref, cur, col).first()[0]
    ref_mean = ref.select(to_double(F.col(col)).alias("x")).agg(F.avg("x")).first()[0]
    cur_mean = cur.select(to_double(F.col(col)).alias("x")).agg(F.avg("x")).first()[0]
    # four numbers from four aggregations: the report row is built on the driver
    return ref.sparkSession.createDataFrame(
        [(psi, ks, ref_mean if ref_mean is not None else 0.0, cur_mean if cur_mean is not None else 0.0)],
        "psi double, ks_stat double, ref_mean_proba double, cur_mean_proba double",
    )


def label_drift(cur: DataFrame, target: str, ref_rate: float, tolerance: float = 0.10) -> DataFrame:
    """|current positive rate − reference rate| > tolerance."""
    y = to_double(F.col(target))
    return cur.agg(F.coalesce(F.avg(y), F.lit(0.0)).alias("cur_positive_rate")).select(
        F.lit(float(ref_rate)).alias("ref_positive_rate"),
        "cur_positive_rate",
        F.abs(F.col("cur_positive_rate") - F.lit(float(ref_rate))).alias("drift_magnitude"),
    ).withColumn("is_drifted", F.col("drift_magnitude") > F.lit(float(tolerance)))


def mean_shift(cur: DataFrame, ref_stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Shared core of D1/D5: current mean/min/max joined to reference stats (long form, one pass)."""
    present = [c for c in cols if c in cur.columns]
    aggs = []
    for c in present:
        x = to_double(F.col(c))
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = cur.agg(*aggs)
    stack = "stack({}, {}) AS (column_name, cur_n, cur_mean, cur_min, cur_max)".format(
        len(present), ", ".join(f"'{c}', `{c}__n`, `{c}__mean`, `{c}__min`, `{c}__max`" for c in present)
    )
    long = wide.selectExpr(stack)
    return ref_stats.join(long, "column_name", "left")


def distribution_violations(cur: DataFrame, ref_stats: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(column_name, check) violations vs reference stats (mean ± tol·σ, generous min/max bounds)."""
    cols = [r["column_name"] for r in ref_stats.select("column_name").collect()]  # O(columns)
    j = mean_shift(cur, ref_stats, cols)
    checks = F.array(
        F.when(F.col("cur_n").isNull(), F.lit("existence")),
        F.when(F.col("cur_n") == 0, F.lit("non_empty")),
        F.when(
            (F.col("cur_n") > 0) & (F.col("std") > 0)
            & (F.abs(F.col("cur_mean") - F.col("mean")) > F.lit(float(tolerance)) * F.col("std")),
            F.lit("mean_drift"),
        ),
        F.when(
            (F.col("cur_n") > 0) & F.col("min").isNotNull()
            & (F.col("cur_min") < F.col("min") * 0.5 - F.abs(F.col("min"))),
            F.lit("range_min"),
        ),
        F.when(
            (F.col("cur_n") > 0) & F.col("max").isNotNull()
            & (F.col("cur_max") > F.col("max") * 2.0 + F.abs(F.col("max"))),
            F.lit("range_max"),
        ),
    )
    return j.select("column_name", F.explode(F.array_compact(checks)).alias("check"))


def serving_skew(cur: DataFrame, ref_stats: DataFrame, cols: Sequence[str], tolerance: float = 2.0) -> DataFrame:
    """Features whose current mean moved more than tol·σ_ref; z = |Δmean| / σ_ref."""
    j = mean_shift(cur, ref_stats, cols).where(F.col("cur_n") > 0)
    z = F.abs(F.col("cur_mean") - F.col("mean")) / F.col("std")
    return j.where((F.col("std") > 0) & (F.abs(F.col("cur_mean") - F.col("mean")) > F.lit(float(tolerance)) * F.col("std"))).select(
        "column_name", F.col("mean").alias("ref_mean"), "cur_mean", z.alias("z_score")
    )


def correlation_drift(
    cur: DataFrame, reference: Sequence[tuple[str, float | None]], threshold: float = 0.20
) -> list[tuple[str, float | None, float | None, float | None, bool]]:
    """Tracked pairs 'a__b' → (pair, ref r, cur r, |Δ|, drifted); pairs with missing columns skipped."""
    pairs = []
    for key, _ in reference:
        parts = key.split("__")
        if len(parts) == 2 and parts[0] in cur.columns and parts[1] in cur.columns:
            pairs.append((parts[0], parts[1]))
    cur_r = pair_correlations(cur, pairs)
    out = []
    for key, ref_val in reference:
        parts = tuple(key.split("__"))
        if parts not in cur_r:
            continue
        c = cur_r[parts]
        if c is None or ref_val is None:
            out.append((key, ref_val, c, None, False))
            continue
        d = abs(c - ref_val)
        out.append((key, ref_val, c, d, d > threshold))
    return out


def importance_drift(current: DataFrame, reference: DataFrame, top_k: int = 10, rank_drop: int = 5) -> DataFrame:
    """Rank features by importance (desc, name), compare ranks of the reference top-k.

    Inputs are (feature, importance) tables — O(features) rows, so the
    un-partitioned rank window is bounded.  Missing current rank → number of
    current features.  Adds the Spearman correlation over shared features when ≥ 3.
    """
    w_ref = Window.orderBy(F.desc("importance"), "feature")
    ref_r = reference.select("feature", F.col("importance").alias("ref_importance"), (F.row_number().over(w_ref) - 1).alias("ref_rank"))
    cur_r = current.select("feature", F.col("importance").alias("cur_importance"), (F.row_number().over(w_ref) - 1).alias("cur_rank"))
    n_cur = current.count()
    top = ref_r.where(F.col("ref_rank") < top_k)
    j = top.join(cur_r, "feature", "left").select(
        "feature", "ref_rank", F.coalesce("cur_rank", F.lit(n_cur)).alias("cur_rank"),
        "ref_importance", F.coalesce("cur_importance", F.lit(0.0)).alias("cur_importance"),
    ).withColumn("rank_change", F.col("cur_rank") - F.col("ref_rank"))
    shared = ref_r.join(cur_r, "feature")  # J10
    ws = Window.orderBy("ref_rank")
    wc = Window.orderBy("cur_rank")
    reranked = shared.select((F.rank().over(ws)).cast("double").alias("a"), (F.rank().over(wc)).cast("double").alias("b"))
    stats = reranked.agg(F.count(F.lit(1)).alias("n"), F.covar_samp("a", "b").alias("cv"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"))
    rho = F.when(F.col("n") >= 3, F.try_divide(F.col("cv"), F.col("sa") * F.col("sb")))
    spearman = stats.select(rho.alias("rank_correlation")).first()[0]
    return j.withColumn("changed", F.abs("rank_change") >= rank_drop).withColumn(
        "rank_correlation", F.lit(spearman).cast("double")
    )

