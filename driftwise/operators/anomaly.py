"""Row-level and table-level anomaly checks.

Each check is one aggregation pass (``count_if`` per rule) or a keyed join; the
per-row variant adds an ``anomaly_types`` array so offending rows can be routed
to a quarantine table without a second scan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.scalar import to_double


def _num(c: str) -> Column:
    return to_double(F.col(c))


def _num0(c: str) -> Column:
    return F.coalesce(_num(c), F.lit(0.0))


def row_anomaly_rules(columns: Sequence[str]) -> list[tuple[str, Column]]:
    """V7 rule table (booking defaults); a rule is skipped when its columns are absent."""
    cols = set(columns)
    rules: list[tuple[str, Column]] = []
    if {"adults", "children", "babies"} <= cols:
        rules.append(("zero_guests", (_num0("adults") == 0) & (_num0("children") == 0) & (_num0("babies") == 0)))
    if "adr" in cols:
        rules.append(("negative_adr", _num("adr") < -10))
    if {"stays_in_weekend_nights", "stays_in_week_nights"} <= cols:
        rules.append(("extreme_stay", (_num0("stays_in_weekend_nights") + _num0("stays_in_week_nights")) > 365))
    if "lead_time" in cols:
        rules.append(("extreme_lead_time", _num("lead_time") > 800))
    if "adults" in cols:
        rules.append(("extreme_adults", _num("adults") > 50))
    return [(name, F.coalesce(pred, F.lit(False))) for name, pred in rules]


def tag_row_anomalies(df: DataFrame, out_col: str = "anomaly_types") -> DataFrame:
    """Adds ``anomaly_types array<string>`` (empty when the row is clean)."""
    rules = row_anomaly_rules(df.columns)
    if not rules:
        return df.withColumn(out_col, F.array().cast("array<string>"))
    tags = F.array(*[F.when(pred, F.lit(name)) for name, pred in rules])
    return df.withColumn(out_col, F.array_compact(tags))


def row_anomaly_counts(df: DataFrame) -> DataFrame:
    """A5/V7: one pass, one row: count per rule plus rows hit by any rule."""
    rules = row_anomaly_rules(df.columns)
    any_rule = F.lit(False)
    for _, pred in rules:
        any_rule = any_rule | pred
    aggs = [F.count_if(pred).alias(name) for name, pred in rules]
    return df.agg(*aggs, F.count_if(any_rule).alias("n_anomalies"), F.count(F.lit(1)).alias("n_rows"))


def row_anomaly_long(df: DataFrame) -> DataFrame:
    """Counts per rule in long form (rule, n); rules with zero hits are dropped as in the reference."""
    wide = row_anomaly_counts(df)
    names = [n for n, _ in row_anomaly_rules(df.columns)]
    stack = "stack({}, {}) AS (anomaly_type, n)".format(len(names), ", ".join(f"'{n}', `{n}`" for n in names))
    return wide.selectExpr(stack).where("n > 0")


def anomalous_rows_sample(df: DataFrame, key_col: str, n: int = 20) -> DataFrame:
    """The first ``n`` anomalous rows by key (a top-k feature, so a limit is the point)."""
    tagged = tag_row_anomalies(df)
    return tagged.where(F.size("anomaly_types") > 0).orderBy(key_col).limit(n)


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """A4/V8: duplicates = rows − distinct groups (NULLs compare equal, keep first).

    ``groupBy`` on the subset is a partial+final aggregation: a hot group only
    ever ships one partial count per map task.
    """
    cols = list(subset) if subset else df.columns
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_total"),
        (F.coalesce(F.sum("_c"), F.lit(0)) - F.count(F.lit(1))).cast("long").alias("n_duplicates"),
    ).select(
        "n_duplicates",
        "n_total",
        F.coalesce(F.try_divide(F.col("n_duplicates").cast("double"), F.col("n_total").cast("double")), F.lit(0.0)).alias(
            "duplicate_ratio"
        ),
    )


def null_counts(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """A3/V9: (column, n_null) for columns that still hold NULL/NaN, one pass."""
    cols = [c for c in df.columns if c not in set(exclude)]
    dtypes = dict(df.dtypes)

    def missing(c: str) -> Column:
        m = F.col(c).isNull()
        if dtypes[c] in ("double", "float"):
            m = m | F.isnan(c)
        return m

    wide = df.agg(*[F.count_if(missing(c)).alias(c) for c in cols])
    stack = "stack({}, {}) AS (column_name, n_null)".format(len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    return wide.selectExpr(stack)


def unseen_categories(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) present in ``df`` but not in the reference, long form.

    Long form → ``distinct`` (partial aggregation) → left-anti join on
    (column_name, value).  The reference side is the set of seen categories; it
    is joined by key, never collected.
    """
    cur = long_strings(df, columns).distinct()
    ref = long_strings(reference, columns).distinct()
    return cur.join(ref, ["column_name", "value"], "left_anti")


def long_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value string) for the non-null values of ``columns``."""
    stack = "stack({}, {}) AS (column_name, value)".format(
        len(columns), ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    )
    return df.selectExpr(stack).where("value IS NOT NULL")


def output_range(df: DataFrame, col: str, tol: float = 1e-6) -> DataFrame:
    """NaN count, out-of-[0,1]±tol count, min, max of a probability column."""
    p = F.col(col).cast("double")
    finite = F.when(~F.isnan(p), p)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.isnan(p) | p.isNull()).alias("n_nan"),
        F.count_if(~F.isnan(p) & ((p < -tol) | (p > 1 + tol))).alias("n_out_of_range"),
        F.min(finite).alias("min_value"),
        F.max(finite).alias("max_value"),
    ).withColumn("passed", (F.col("n_nan") == 0) & (F.col("n_out_of_range") == 0))


def volume_bounds(expected: int, tolerance: float) -> tuple[int, int]:
    """V12 range: [max(1, ⌊n(1−t)⌋), ⌊n(1+t)⌋]."""
    lo = max(1, int(math.floor(expected * (1 - tolerance))))
    hi = int(math.floor(expected * (1 + tolerance)))
    return lo, hi


def volume_check(df: DataFrame, expected: int, tolerance: float = 0.5) -> DataFrame:
    lo, hi = volume_bounds(expected, tolerance)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(lo).cast("long").alias("expected_low"),
        F.lit(hi).cast("long").alias("expected_high"),
        ((F.col("n_rows") < lo) | (F.col("n_rows") > hi)).alias("is_anomalous"),
    )


def row_count_reconcile(counts: DataFrame, expected: Mapping[str, int], tolerance: int = 5) -> DataFrame:
    """Per split, |actual − expected| ≤ tolerance.  ``counts`` has (split, n_rows)."""
    exp_rows = [(k, int(v)) for k, v in expected.items()]
    exp = counts.sparkSession.createDataFrame(exp_rows, "split string, expected long")
    return (
        counts.join(F.broadcast(exp), "split", "full_outer")
        .select(
            "split",
            F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
            "expected",
            F.abs(F.coalesce("n_rows", F.lit(0)) - F.col("expected")).cast("long").alias("abs_diff"),
        )
        .withColumn("ok", F.col("abs_diff") <= tolerance)
    )


def staleness(df: DataFrame, max_age_days: float, as_of_col: Column) -> DataFrame:
    """Age in days of the newest file behind ``df`` (``_metadata``) vs a limit."""
    newest = df.select(F.col("_metadata.file_modification_time").alias("mt")).agg(F.max("mt").alias("newest"))
    age = (as_of_col.cast("double") - F.col("newest").cast("double")) / F.lit(86400.0)
    return newest.select(
        "newest", age.alias("age_days"), F.coalesce(age > F.lit(float(max_age_days)), F.lit(False)).alias("is_stale")
    )
