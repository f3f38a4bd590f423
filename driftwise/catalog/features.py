"""Named queries for preprocessing, features (step 5) and splits (step 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.functions.scalar import pround, rnd
from driftwise.operators import anomaly as an
from driftwise.operators import features as fe
from driftwise.operators import split as sp
from driftwise.sources.files import persist_splits, scratch_path
from driftwise.sources.tables import bookings

# The reference's label map (strings lower-cased and stripped first).
LABEL_MAP = {"yes": 1, "no": 0, "1": 1, "0": 0}
BLOCKED = ["y", "score", "period", "booked_on"]
IMPUTE_NUM = ["lead_time", "adults", "children", "babies", "adr"]
IMPUTE_CAT = ["hotel", "country", "market_segment", "customer_type", "arrival_date_month"]
OHE_COLS = ["hotel", "market_segment", "arrival_date_year"]

_MED = "(SELECT quantile_cont({c}, 0.5) FROM bookings)"


@register(
    "preprocess_basic",
    with_bookings(
        f"""
SELECT booking_id,
       CAST(CASE lower(trim(is_canceled)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 WHEN '1' THEN 1 WHEN '0' THEN 0 END AS BIGINT) AS is_canceled,
       coalesce(CAST(adults AS DOUBLE), {_MED.format(c='adults')}) AS adults,
       coalesce(CAST(children AS DOUBLE), {_MED.format(c='children')}) AS children,
       coalesce(CAST(babies AS DOUBLE), {_MED.format(c='babies')}) AS babies,
       round(coalesce(adr, {_MED.format(c='adr')}), 6) AS adr,
       lead_time, hotel, country, market_segment
FROM bookings"""
    ),
)
def preprocess_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strip names, drop blocked columns, map yes/no labels (unknown → error), drop all-NULL
    columns, median / mode imputation of the columns that hold NULLs."""
    out = fe.preprocess_basic(bookings(spark, sf_dir), "is_canceled", LABEL_MAP, blocked=BLOCKED)
    return out.select(
        "booking_id", "is_canceled", "adults", "children", "babies", rnd(F.col("adr")).alias("adr"),
        "lead_time", "hotel", "country", "market_segment",
    )


def _mode_sql(c):
    return (
        f"SELECT '{c}' AS column_name, 'mode' AS strategy, CAST(NULL AS DOUBLE) AS num_fill, "
        f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM bookings WHERE {c} IS NOT NULL GROUP BY 1) "
        f"ORDER BY n DESC, v LIMIT 1) AS cat_fill"
    )


@register(
    "impute_median_mode",
    with_bookings(
        "\nUNION ALL ".join(
            [
                f"SELECT '{c}' AS column_name, 'median' AS strategy, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS num_fill, "
                f"CAST(NULL AS VARCHAR) AS cat_fill FROM bookings"
                for c in IMPUTE_NUM
            ]
            + [_mode_sql(c) for c in IMPUTE_CAT]
        )
    ),
)
def impute_median_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted fill values — exact median per numeric column, mode (lowest on ties) per categorical column."""
    fills = fe.fit_imputer(bookings(spark, sf_dir), IMPUTE_NUM, IMPUTE_CAT)
    rows = [(c, "median", None if fills[c] is None else pround(float(fills[c]), 6), None) for c in IMPUTE_NUM]
    rows += [(c, "mode", None, fills[c]) for c in IMPUTE_CAT]
    return spark.createDataFrame(rows, "column_name string, strategy string, num_fill double, cat_fill string")


_MONTH_CASE = (
    "CASE lower(trim(arrival_date_month)) WHEN 'january' THEN 1 WHEN 'february' THEN 2 WHEN 'march' THEN 3 "
    "WHEN 'april' THEN 4 WHEN 'may' THEN 5 WHEN 'june' THEN 6 WHEN 'july' THEN 7 WHEN 'august' THEN 8 "
    "WHEN 'september' THEN 9 WHEN 'october' THEN 10 WHEN 'november' THEN 11 WHEN 'december' THEN 12 "
    "WHEN 'jan' THEN 1 WHEN 'feb' THEN 2 WHEN 'mar' THEN 3 WHEN 'apr' THEN 4 WHEN 'jun' THEN 6 WHEN 'jul' THEN 7 "
    "WHEN 'aug' THEN 8 WHEN 'sep' THEN 9 WHEN 'oct' THEN 10 WHEN 'nov' THEN 11 WHEN 'dec' THEN 12 END"
)


@register(
    "month_cyclic",
    with_bookings(
        f"""
SELECT booking_id, round(sin(6.283185307179586 * m / 12.0), 6) AS arrival_date_month_sin,
       round(cos(6.283185307179586 * m / 12.0), 6) AS arrival_date_month_cos
FROM (SELECT booking_id, coalesce(CAST({_MONTH_CASE} AS DOUBLE), TRY_CAST(trim(arrival_date_month) AS DOUBLE), 0.0) AS m FROM bookings)"""
    ),
)
def month_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival month (name, abbreviation or number; unknown → 0) → sin / cos of 2π·m/12."""
    out = fe.cyclic_month(bookings(spark, sf_dir).select("booking_id", "arrival_date_month"), "arrival_date_month")
    return out.select("booking_id", rnd(F.col("arrival_date_month_sin")).alias("arrival_date_month_sin"),
                      rnd(F.col("arrival_date_month_cos")).alias("arrival_date_month_cos"))


@register(
    "frequency_encode",
    with_bookings(
        """
SELECT c.booking_id, c.country, round(coalesce(f.freq, 0.0), 6) AS country_freq
FROM (SELECT * FROM bookings WHERE period = 'cur') c
LEFT JOIN (SELECT country, count(*) / CAST((SELECT count(*) FROM bookings WHERE period = 'ref') AS DOUBLE) AS freq
           FROM bookings WHERE period = 'ref' GROUP BY country) f ON f.country = c.country"""
    ),
)
def frequency_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country share fitted on the reference period, applied to the current period (unseen → 0.0)."""
    b = bookings(spark, sf_dir)
    model = fe.FrequencyEncoder(["country"]).fit(b.where(F.col("period") == "ref"))
    out = model.transform(b.where(F.col("period") == "cur").select("booking_id", "country"), suffix="_freq")
    return out.select("booking_id", "country", rnd(F.col("country_freq")).alias("country_freq"))


@register(
    "standardise",
    with_bookings(
        """
SELECT booking_id, round((lead_time - avg(lead_time) OVER ()) / stddev_pop(lead_time) OVER (), 6) AS lead_time_z,
       round((adr_f - avg(adr_f) OVER ()) / stddev_pop(adr_f) OVER (), 6) AS adr_z
FROM (SELECT booking_id, CAST(lead_time AS DOUBLE) AS lead_time,
             coalesce(adr, (SELECT quantile_cont(adr, 0.5) FROM bookings)) AS adr_f FROM bookings)"""
    ),
)
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median imputation then (x − mean) / population σ for lead_time and adr."""
    out = fe.standardise(bookings(spark, sf_dir).select("booking_id", "lead_time", "adr"), ["lead_time", "adr"])
    return out.select("booking_id", rnd(F.col("lead_time_z")).alias("lead_time_z"), rnd(F.col("adr_z")).alias("adr_z"))


def _ohe_sql(c):
    v = f"CAST({c} AS VARCHAR)"
    return (
        f"SELECT '{c}' AS column_name, r.v AS category, count(cu.v) AS n_ones FROM "
        f"(SELECT DISTINCT {v} AS v FROM bookings WHERE period = 'ref') r "
        f"LEFT JOIN (SELECT {v} AS v FROM bookings WHERE period = 'cur') cu ON cu.v = r.v GROUP BY ALL "
        f"UNION ALL SELECT '{c}', '__unknown__', count_if({v} NOT IN (SELECT DISTINCT {v} FROM bookings WHERE period = 'ref')) "
        f"FROM bookings WHERE period = 'cur'"
    )


@register("one_hot_counts", with_bookings("\nUNION ALL ".join(_ohe_sql(c) for c in OHE_COLS)))
def one_hot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """StringIndexer(keep) + OneHotEncoder(dropLast) fitted on the reference period and applied to the
    current one; ones per category slot plus all-zero (unknown) rows."""
    b = bookings(spark, sf_dir)
    encoded, labels = fe.one_hot_fit_apply(b.where(F.col("period") == "ref"), b.where(F.col("period") == "cur"), OHE_COLS)
    return fe.one_hot_slot_counts(encoded, labels)


@register(
    "arrival_features",
    with_bookings(
        """
SELECT booking_id, strftime(booked_on + lead_time, '%Y-%m-%d') AS arrival_date, year(booked_on + lead_time) AS arrival_year,
       monthname(booked_on + lead_time) AS arrival_month, weekofyear(booked_on + lead_time) AS arrival_week,
       day(booked_on + lead_time) AS arrival_day
FROM bookings"""
    ),
)
def arrival_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival date = booking date + lead time → year, month name, ISO week, day of month."""
    out = fe.arrival_features(bookings(spark, sf_dir).select("booking_id", "booked_on", "lead_time"), "booked_on", "lead_time")
    return out.select(
        "booking_id", "arrival_date", F.col("arrival_year").cast("long").alias("arrival_year"), "arrival_month",
        F.col("arrival_week").cast("long").alias("arrival_week"), F.col("arrival_day").cast("long").alias("arrival_day"),
    )


_H = "CAST(('0x' || substr(md5(CAST(booking_id AS VARCHAR) || '{salt}'), 1, 13)) AS BIGINT)"
_SPLIT1 = f"""
h1 AS (SELECT booking_id, y, {_H.format(salt=':42')} AS h FROM bookings),
r1 AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, booking_id) - 1 AS rk FROM h1),
k1 AS (SELECT y, CAST(floor(count(*) * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS k FROM h1 GROUP BY y),
s1 AS (SELECT r1.booking_id, r1.y, r1.rk < k1.k AS held_out FROM r1 JOIN k1 USING (y))"""


@register(
    "stratified_split",
    with_bookings(
        "SELECT held_out, y, count(*) AS n_rows, CAST(sum(booking_id) AS BIGINT) AS key_sum FROM s1 GROUP BY ALL", _SPLIT1
    ),
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: exact stratified 20 % hold-out per class by MD5 hash order (grouped ranks, no per-class window)."""
    out = sp.stratified_split(bookings(spark, sf_dir).select("booking_id", "y"), "booking_id", "y", 0.20, ":42")
    return out.groupBy("held_out", "y").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("booking_id").cast("long").alias("key_sum"))


_SPLIT3 = (
    _SPLIT1
    + f""",
h2 AS (SELECT booking_id, y, {_H.format(salt=':43')} AS h FROM s1 WHERE NOT held_out),
r2 AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, booking_id) - 1 AS rk FROM h2),
k2 AS (SELECT y, CAST(floor(count(*) * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS k FROM h2 GROUP BY y),
s3 AS (SELECT booking_id, y, 'test' AS split FROM s1 WHERE held_out
       UNION ALL SELECT r2.booking_id, r2.y, CASE WHEN r2.rk < k2.k THEN 'cal' ELSE 'train' END FROM r2 JOIN k2 USING (y))"""
)


def _three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, persist partitioned by split (S9) in the shared scratch folder, read back."""
    parts = sp.three_way_split(bookings(spark, sf_dir).select("booking_id", "y"), "booking_id", "y")
    path = scratch_path(spark, "splits")
    persist_splits(parts, path)
    return spark.read.parquet(path)


@register(
    "three_way_split",
    with_bookings(
        "SELECT split, count(*) AS n_rows, round(avg(CAST(y AS DOUBLE)), 6) AS positive_rate, CAST(sum(booking_id) AS BIGINT) AS key_sum "
        "FROM s3 GROUP BY split",
        _SPLIT3,
    ),
)
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64/16/20 train/cal/test by two stratified hash-order cuts, persisted by split; sizes and rates."""
    out = sp.split_summary(_three_way(spark, sf_dir), "split", "y", "booking_id")
    return out.select("split", "n_rows", rnd(F.col("positive_rate")).alias("positive_rate"), "key_sum")


@register(
    "row_count_reconcile",
    with_bookings(
        """
SELECT a.split, a.n_rows, e.expected, abs(a.n_rows - e.expected) AS abs_diff, abs(a.n_rows - e.expected) <= 5 AS ok
FROM (SELECT split, count(*) AS n_rows FROM s3 GROUP BY split) a
JOIN (SELECT 'test' AS split, t AS expected FROM n UNION ALL SELECT 'cal', c FROM n UNION ALL SELECT 'train', total - t - c FROM n) e
  USING (split)""",
        _SPLIT3
        + """,
n0 AS (SELECT count(*) AS total, CAST(floor(count(*) * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS t FROM bookings),
n AS (SELECT total, t, CAST(floor((total - t) * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS c FROM n0)""",
    ),
)
def row_count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted split sizes vs the whole-table 64/16/20 expectation, tolerance 5 rows."""
    parts = _three_way(spark, sf_dir)
    counts = parts.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    n = bookings(spark, sf_dir).count()
    return an.row_count_reconcile(counts, sp.expected_sizes(n), 5).select(
        "split", "n_rows", "expected", "abs_diff", "ok"
    ).where(F.col("split").isNotNull())


_KFOLD = f"""
hk AS (SELECT booking_id, y, {_H.format(salt=':7')} AS h FROM bookings),
rk AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY h, booking_id) - 1) % 5 AS fold FROM hk)"""


@register(
    "kfold_assign",
    with_bookings(
        "SELECT CAST(fold AS INTEGER) AS fold, y, count(*) AS n_rows, CAST(sum(booking_id) AS BIGINT) AS key_sum FROM rk GROUP BY ALL",
        _KFOLD,
    ),
)
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: stratified 5-fold column (rank inside class by hash, mod 5); fold sizes and key checksums."""
    out = sp.kfold(bookings(spark, sf_dir).select("booking_id", "y"), "booking_id", "y", 5)
    return out.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("booking_id").cast("long").alias("key_sum"))
