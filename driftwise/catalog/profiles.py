"""Named queries for dataset profiles (step 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.catalog.sqlgen import bin_expr
from driftwise.functions.scalar import month_number, pround, rnd
from driftwise.operators import profile as pf
from driftwise.sources.tables import bookings

PROFILE_COLS = [
    "lead_time", "adults", "children", "babies", "adr", "stays_in_week_nights",
    "stays_in_weekend_nights", "arrival_date_day_of_month", "score",
]
CATEGORY_COLS = ["hotel", "country", "market_segment", "customer_type", "arrival_date_month"]
CORR_TOP_K = 20


def _ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookings(spark, sf_dir).where(F.col("period") == "ref")


def _profile_sql(cols, source):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, "
            f"round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(quantile_cont({x}, 0.5), 6) AS median, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.75), 6) AS q75 FROM {source}"
        )
    return "\nUNION ALL ".join(parts)


@register(
    "reference_stats",
    with_bookings(_profile_sql(PROFILE_COLS, "ref"), "ref AS (SELECT * FROM bookings WHERE period = 'ref')"),
)
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: reference-period profile per numeric column (n, mean, sample std, min, max, exact median/q25/q75)."""
    return pf.numeric_profile(_ref(spark, sf_dir), PROFILE_COLS)


@register(
    "reference_categories",
    with_bookings(
        """
SELECT DISTINCT column_name, value FROM (
  SELECT 'hotel' AS column_name, CAST(hotel AS VARCHAR) AS value FROM bookings WHERE period = 'ref' UNION ALL
  SELECT 'country', CAST(country AS VARCHAR) FROM bookings WHERE period = 'ref' UNION ALL
  SELECT 'market_segment', CAST(market_segment AS VARCHAR) FROM bookings WHERE period = 'ref' UNION ALL
  SELECT 'customer_type', CAST(customer_type AS VARCHAR) FROM bookings WHERE period = 'ref' UNION ALL
  SELECT 'arrival_date_month', CAST(arrival_date_month AS VARCHAR) FROM bookings WHERE period = 'ref')
WHERE value IS NOT NULL"""
    ),
)
def reference_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct reference-period categories per categorical column (long form)."""
    return pf.distinct_categories(_ref(spark, sf_dir), CATEGORY_COLS)


def corr_list_sql(pairs, source):
    """Oracle rows ``(a, b, r)`` of all column pairs from one aggregation of ``source``."""
    each = ",\n    ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))}}" for a, b in pairs)
    return f"SELECT unnest(l, recursive := true) FROM (SELECT [{each}] AS l FROM {source}) one_row"


def _corr_sql(cols, target, top_k, source):
    """Oracle for D3: rank features by |r with target| in DuckDB, then name pairs in rank order."""
    tc = corr_list_sql([(c, target) for c in cols], source)
    pr = corr_list_sql([(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]], source)
    order = f"(SELECT unnest({list(cols)!r}) AS f, generate_subscripts({list(cols)!r}, 1) AS ord)"
    return f"""
tc AS (SELECT p.a AS f, o.ord, p.r FROM ({tc}) p JOIN {order} o ON o.f = p.a),
rk AS (SELECT f, r, row_number() OVER (ORDER BY abs(r) DESC, ord) AS k FROM tc WHERE r IS NOT NULL AND NOT isnan(r)),
top AS (SELECT * FROM rk WHERE k <= {top_k}),
allp AS ({pr}),
sym AS (SELECT a, b, r FROM allp UNION ALL SELECT b AS a, a AS b, r FROM allp)
""", f"""
SELECT x.f || '__' || y.f AS pair, round(s.r, 6) AS corr
FROM top x JOIN top y ON x.k < y.k JOIN sym s ON s.a = x.f AND s.b = y.f
UNION ALL
SELECT f || '__{target}' AS pair, round(r, 6) AS corr FROM top"""


_CORR_CTES, _CORR_BODY = _corr_sql(PROFILE_COLS, "y", CORR_TOP_K, "ref")


@register(
    "reference_correlations",
    with_bookings(_CORR_BODY, "ref AS (SELECT * FROM bookings WHERE period = 'ref'),\n" + _CORR_CTES.strip()),
)
def reference_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 features by |r with y|, all pairs among them plus feature–target pairs."""
    rows = pf.reference_correlations(_ref(spark, sf_dir), PROFILE_COLS, "y", CORR_TOP_K)
    out = [(k, None if v is None else pround(v, 6)) for k, v in rows]
    return spark.createDataFrame(out, "pair string, corr double")


@register(
    "value_counts_topn",
    with_bookings(
        """
SELECT country AS value, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM bookings) AS DOUBLE), 6) AS share,
       (SELECT count(DISTINCT country) FROM bookings) AS n_unique
FROM bookings GROUP BY country ORDER BY n DESC, value LIMIT 20"""
    ),
)
def value_counts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country value counts with shares, top 20 (ties by value), plus the number of distinct values."""
    b = bookings(spark, sf_dir)
    vc = pf.value_counts(b, "country")
    n_unique = vc.count()
    return (
        vc.select("value", "n", rnd(F.col("share")).alias("share"), F.lit(n_unique).cast("long").alias("n_unique"))
        .orderBy(F.desc("n"), "value")
        .limit(20)
    )


@register(
    "cancel_rate_by_month",
    with_bookings(
        """
SELECT CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(arrival_date_month)) - 1) // 3 + 1 AS DOUBLE) AS month_num,
       arrival_date_month, count(*) AS n_rows, round(avg(y), 6) AS cancel_rate
FROM bookings GROUP BY arrival_date_month"""
    ),
)
def cancel_rate_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive rate of y per arrival month, keyed by calendar month number for ordering."""
    b = bookings(spark, sf_dir)
    return (
        b.groupBy("arrival_date_month")
        .agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("y")).alias("cancel_rate"))
        .withColumn("month_num", month_number(F.col("arrival_date_month")))
        .orderBy("month_num")
    )


@register(
    "histogram_fixed",
    with_bookings(
        """
SELECT CAST(g.bin AS INTEGER) AS bin, lo + CAST(g.bin AS DOUBLE) * ((hi - lo) / CAST(30 AS DOUBLE)) AS bin_lo,
       CASE WHEN g.bin = 29 THEN hi ELSE lo + CAST(g.bin + 1 AS DOUBLE) * ((hi - lo) / CAST(30 AS DOUBLE)) END AS bin_hi,
       coalesce(c.n, 0) AS n
FROM (SELECT unnest(range(0, 30)) AS bin) g CROSS JOIN rng
LEFT JOIN (SELECT bin, count(*) AS n FROM binned GROUP BY bin) c ON c.bin = g.bin""",
        """
x AS (SELECT CAST(lead_time AS DOUBLE) AS value FROM bookings WHERE lead_time IS NOT NULL),
rng AS (SELECT min(value) AS lo, max(value) AS hi FROM x),
binned AS (SELECT """
        + bin_expr("value", "lo", "hi", 30)
        + """ AS bin FROM x CROSS JOIN rng)""",
    ),
)
def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 equal-width bins of lead_time over its [min, max], last bin closed, empty bins kept."""
    return pf.fixed_histogram(bookings(spark, sf_dir), "lead_time", 30)


def _describe_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS n, count(*) - count({x}) AS n_missing, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q25, "
            f"round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM bookings"
        )
    return "\nUNION ALL ".join(parts)


@register("describe_summary", with_bookings(_describe_sql(PROFILE_COLS)), materialize=True)
def describe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: EDA describe of every numeric bookings column over both periods — count, missing, mean, std, min,
    exact quartiles, max."""
    b = bookings(spark, sf_dir)
    prof = pf.numeric_profile(b, PROFILE_COLS)
    total = b.count()
    return prof.select(
        "column_name", "n", (F.lit(total) - F.col("n")).alias("n_missing"), "mean", "std", "min", "q25", "median", "q75", "max"
    )


@register(
    "reference_profiles",
    with_bookings(
        f"""
SELECT 'reference_stats' AS artefact, count(*) AS n_rows FROM (SELECT DISTINCT 1 FROM ref) x, (SELECT unnest({PROFILE_COLS!r}) AS c) cols
UNION ALL SELECT 'reference_categories', count(*) FROM (
  SELECT DISTINCT column_name, value FROM (
    SELECT 'hotel' AS column_name, CAST(hotel AS VARCHAR) AS value FROM ref UNION ALL
    SELECT 'country', CAST(country AS VARCHAR) FROM ref UNION ALL
    SELECT 'market_segment', CAST(market_segment AS VARCHAR) FROM ref UNION ALL
    SELECT 'customer_type', CAST(customer_type AS VARCHAR) FROM ref UNION ALL
    SELECT 'arrival_date_month', CAST(arrival_date_month AS VARCHAR) FROM ref) WHERE value IS NOT NULL)
UNION ALL SELECT 'reference_correlations', count(*) FROM (SELECT x.f FROM top x JOIN top y ON x.k < y.k UNION ALL SELECT f FROM top)""",
        "ref AS (SELECT * FROM bookings WHERE period = 'ref'),\n" + _CORR_CTES.strip(),
    ),
    materialize=True,
)
def reference_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference artefacts saved at training time — numeric profile (A1), categories (A6) and tracked
    correlations (D3) — written as tables to the shared scratch folder and read back (row count per artefact)."""
    from driftwise.sources.files import scratch_path

    ref = _ref(spark, sf_dir)
    base = scratch_path(spark, "reference-profiles")
    pf.numeric_profile(ref, PROFILE_COLS).write.mode("overwrite").parquet(f"{base}/reference_stats")
    pf.distinct_categories(ref, CATEGORY_COLS).write.mode("overwrite").parquet(f"{base}/reference_categories")
    corr = pf.reference_correlations(ref, PROFILE_COLS, "y", CORR_TOP_K)
    spark.createDataFrame([(k, v) for k, v in corr], "pair string, corr double").write.mode("overwrite").parquet(f"{base}/reference_correlations")
    parts = [spark.read.parquet(f"{base}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("artefact"), "n_rows")
             for name in ("reference_stats", "reference_categories", "reference_correlations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
