"""Dataset profiles (A1–A12): one-pass moments, exact quantiles, categories, correlations, histograms.

Moments for all columns come from a single ``agg``.  Quantiles are exact
(linear interpolation, like numpy and DuckDB ``quantile_cont``) through
``plans.ordering.exact_quantiles_many``: low-cardinality columns resolve from
one grouped count of the long form, others by histogram refinement — never a
single buffer holding every distinct value of a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.scalar import pround, to_double
from driftwise.plans.ordering import exact_quantiles_many

PROFILE_SCHEMA = (
    "column_name string, n long, mean double, std double, min double, max double, "
    "median double, q25 double, q75 double"
)


def numeric_profile(df: DataFrame, cols: Sequence[str], digits: int | None = 6, quantiles: bool = True) -> DataFrame:
    """A1: per column n, mean, std (sample), min, max, median, q25, q75 of parsed non-null values.

    All-NULL columns are skipped.  The result is O(columns) rows built on the driver.
    """
    parsed = df.select(*[to_double(F.col(c)).alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _profile(df, parsed, cols, digits, quantiles)
    finally:
        parsed.unpersist()


def _profile(df: DataFrame, parsed: DataFrame, cols: Sequence[str], digits: int | None, quantiles: bool) -> DataFrame:
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [
            F.count(x).alias(f"{c}__n"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
            F.approx_count_distinct(x, 0.05).alias(f"{c}__d"),
        ]
    row = parsed.agg(*aggs).first()
    live = [c for c in cols if row[f"{c}__n"] > 0]
    if quantiles:
        qs = exact_quantiles_many(
            parsed, live, [0.5, 0.25, 0.75], counts={c: row[f"{c}__n"] for c in live},
            approx_distinct={c: row[f"{c}__d"] for c in live},
        )
    else:
        qs = {c: [None, None, None] for c in live}

    def r(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return pround(float(v), digits) if digits is not None else float(v)

    rows = []
    for c in live:
        med, q25, q75 = qs[c]
        rows.append(
            (c, int(row[f"{c}__n"]), r(row[f"{c}__mean"]), r(row[f"{c}__std"]), r(row[f"{c}__min"]), r(row[f"{c}__max"]), r(med), r(q25), r(q75))
        )
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def distinct_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value) distinct non-null categories, long form, one aggregation."""
    casts = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {casts}) AS (column_name, value)").where("value IS NOT NULL").distinct()


def guarded_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r; NULL (pandas NaN) when either side is constant.

    Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI for a constant column, so
    r = cov / (σa·σb) is computed over the rows where both values are present.
    """
    both = a.isNotNull() & b.isNotNull()
    sa = F.stddev_samp(F.when(both, a))
    sb = F.stddev_samp(F.when(both, b))
    return F.try_divide(F.covar_samp(a, b), sa * sb)


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson r for many pairs in one aggregation (driver gets O(pairs) numbers)."""
    if not pairs:
        return {}
    cols = sorted({c for p in pairs for c in p})
    parsed = df.select(*[to_double(F.col(c)).alias(c) for c in cols])
    row = parsed.agg(*[guarded_corr(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[f"p{i}"] for i, p in enumerate(pairs)}


def reference_correlations(df: DataFrame, numeric_cols: Sequence[str], target: str, top_k: int = 20) -> list[tuple[str, float | None]]:
    """D3: top-k features by |r with target|; all pairs among them (in rank order) + target pairs."""
    target_r = pair_correlations(df, [(c, target) for c in numeric_cols])
    ranked = [c for c in numeric_cols if target_r[(c, target)] is not None]
    ranked.sort(key=lambda c: -abs(target_r[(c, target)]))  # stable: column order breaks ties
    top = ranked[: min(top_k, len(ranked))]
    pairs = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    within = pair_correlations(df, pairs)
    out = [(f"{a}__{b}", within[(a, b)]) for a, b in pairs]
    out += [(f"{c}__{target}", target_r[(c, target)]) for c in top]
    return out


def value_counts(df: DataFrame, col: str, normalize: bool = True) -> DataFrame:
    """(value, n, share).  ``groupBy`` runs partial counts map-side, so a hot value costs one row per task."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count() if normalize else None
    if normalize:
        counts = counts.withColumn("share", F.col("n") / F.lit(float(max(total, 1))))
    return counts


def uniform_bin(x: Column, lo: Column, step: Column, n_bins: int) -> Column:
    """Bin of ``x`` on edges lo + i·step (i = 0..n), last bin closed, as numpy's histogram.

    The estimate floor((x−lo)/step) is corrected by one step against the exact
    edge values, so values on an edge land where an edge comparison puts them.
    """
    k0 = F.least(F.greatest(F.floor((x - lo) / step), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    lower_edge = lo + k0.cast("double") * step
    upper_edge = lo + (k0 + 1).cast("double") * step
    return (
        F.when(x < lower_edge, k0 - 1)
        .when((k0 < n_bins - 1) & (x >= upper_edge), k0 + 1)
        .otherwise(k0)
    )


def fixed_histogram(df: DataFrame, col: str, n_bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram on [lo, hi] (default: data min/max); outside values ignored.

    Returns every bin (empty ones with n = 0): (bin, bin_lo, bin_hi, n).
    """
    x = to_double(F.col(col))
    if lo is None or hi is None:
        mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        lo = mm["lo"] if lo is None else lo
        hi = mm["hi"] if hi is None else hi
    spark = df.sparkSession
    if lo is None or hi is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    lo, hi = float(lo), float(hi)
    step = (hi - lo) / n_bins
    inside = df.select(x.alias("x")).where((F.col("x") >= lo) & (F.col("x") <= hi))
    binned = inside.select(uniform_bin(F.col("x"), F.lit(lo), F.lit(step), n_bins).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    edges_lo = F.lit(lo) + F.col("bin").cast("double") * F.lit(step)
    edges_hi = F.when(F.col("bin") == n_bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1).cast("double") * F.lit(step))
    return grid.join(counts, "bin", "left").select(
        "bin", edges_lo.alias("bin_lo"), edges_hi.alias("bin_hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
