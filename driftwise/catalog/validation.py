"""Named queries for I/O, contracts and validation checks (steps 1–2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.functions.scalar import rnd
from driftwise.operators import anomaly as an
from driftwise.operators import checks as ck
from driftwise.sources.files import read_parquet, scratch_path, write_parquet
from driftwise.sources.tables import bookings, table

NUMERIC = [
    "lead_time", "adults", "children", "babies", "adr", "stays_in_week_nights",
    "stays_in_weekend_nights", "arrival_date_year", "arrival_date_day_of_month",
]
CATEGORICAL = ["hotel", "country", "market_segment", "customer_type", "arrival_date_month"]


@register(
    "scan_roundtrip",
    with_bookings(
        """
SELECT period, count(*) AS n_rows, CAST(sum(lead_time) AS BIGINT) AS sum_lead_time,
       count(adr) AS n_adr, round(avg(adr), 4) AS avg_adr
FROM bookings GROUP BY period"""
    ),
)
def scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write bookings as Parquet partitioned by period to the shared scratch folder, read back, summarise."""
    path = scratch_path(spark, "roundtrip")
    write_parquet(bookings(spark, sf_dir), path, ["period"])
    back = read_parquet(spark, path)
    return back.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("lead_time").cast("long").alias("sum_lead_time"),
        F.count("adr").alias("n_adr"),
        rnd(F.avg("adr"), 4).alias("avg_adr"),
    )


_NULLABLE_SQL = """
SELECT column_name, n_null FROM (
  SELECT 'booking_id' AS column_name, count_if(booking_id IS NULL) AS n_null FROM bookings UNION ALL
  SELECT 'booked_on', count_if(booked_on IS NULL) FROM bookings UNION ALL
  SELECT 'period', count_if(period IS NULL) FROM bookings UNION ALL
  SELECT 'is_canceled', count_if(is_canceled IS NULL) FROM bookings UNION ALL
  SELECT 'y', count_if(y IS NULL) FROM bookings UNION ALL
  SELECT 'hotel', count_if(hotel IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_year', count_if(arrival_date_year IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_month', count_if(arrival_date_month IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_day_of_month', count_if(arrival_date_day_of_month IS NULL) FROM bookings UNION ALL
  SELECT 'lead_time', count_if(lead_time IS NULL) FROM bookings UNION ALL
  SELECT 'adults', count_if(adults IS NULL) FROM bookings UNION ALL
  SELECT 'children', count_if(children IS NULL) FROM bookings UNION ALL
  SELECT 'babies', count_if(babies IS NULL) FROM bookings UNION ALL
  SELECT 'stays_in_week_nights', count_if(stays_in_week_nights IS NULL) FROM bookings UNION ALL
  SELECT 'stays_in_weekend_nights', count_if(stays_in_weekend_nights IS NULL) FROM bookings UNION ALL
  SELECT 'adr', count_if(adr IS NULL OR isnan(adr)) FROM bookings UNION ALL
  SELECT 'country', count_if(country IS NULL) FROM bookings UNION ALL
  SELECT 'market_segment', count_if(market_segment IS NULL) FROM bookings UNION ALL
  SELECT 'customer_type', count_if(customer_type IS NULL) FROM bookings UNION ALL
  SELECT 'score', count_if(score IS NULL OR isnan(score)) FROM bookings)
"""


@register("null_counts", with_bookings(_NULLABLE_SQL))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3/V9: NULL/NaN count for every bookings column, one aggregation pass."""
    return an.null_counts(bookings(spark, sf_dir))


@register(
    "null_ratio_report",
    with_bookings(
        f"""
SELECT column_name, round(CAST(n_null AS DOUBLE) / (SELECT count(*) FROM bookings), 6) AS null_ratio
FROM ({_NULLABLE_SQL}) ORDER BY null_ratio DESC, column_name LIMIT 10"""
    ),
)
def null_ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: null ratio per column, top 10 descending (ties by column name)."""
    b = bookings(spark, sf_dir)
    counts = an.null_counts(b)
    n = b.count()
    return (
        counts.select("column_name", rnd(F.col("n_null") / F.lit(float(max(n, 1)))).alias("null_ratio"))
        .orderBy(F.desc("null_ratio"), "column_name")
        .limit(10)
    )


@register(
    "raw_contract_violations",
    with_bookings(
        """
SELECT * FROM (
  SELECT 'hotel' AS column_name, 'not_null' AS check_name, count_if(hotel IS NULL) AS n_failed FROM bookings UNION ALL
  SELECT 'hotel', 'isin', count_if(hotel NOT IN ('Resort Hotel', 'City Hotel')) FROM bookings UNION ALL
  SELECT 'arrival_date_year', 'not_null', count_if(arrival_date_year IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_year', 'in_range', count_if(arrival_date_year < 2010 OR arrival_date_year > 2030) FROM bookings UNION ALL
  SELECT 'arrival_date_month', 'not_null', count_if(arrival_date_month IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_week_number', 'column_present', 1 UNION ALL
  SELECT 'arrival_date_day_of_month', 'in_range',
         count_if(arrival_date_day_of_month < 1 OR arrival_date_day_of_month > 31) FROM bookings UNION ALL
  SELECT 'stays_in_weekend_nights', 'ge', count_if(stays_in_weekend_nights < 0) FROM bookings UNION ALL
  SELECT 'stays_in_week_nights', 'ge', count_if(stays_in_week_nights < 0) FROM bookings UNION ALL
  SELECT 'adults', 'ge', count_if(adults < 0) FROM bookings UNION ALL
  SELECT 'children', 'ge', count_if(children < 0) FROM bookings UNION ALL
  SELECT 'babies', 'ge', count_if(babies < 0) FROM bookings UNION ALL
  SELECT 'lead_time', 'not_null', count_if(lead_time IS NULL) FROM bookings UNION ALL
  SELECT 'lead_time', 'ge', count_if(lead_time < 0) FROM bookings UNION ALL
  SELECT 'is_repeated_guest', 'column_present', 1 UNION ALL
  SELECT 'previous_cancellations', 'column_present', 1 UNION ALL
  SELECT 'previous_bookings_not_canceled', 'column_present', 1 UNION ALL
  SELECT 'booking_changes', 'column_present', 1 UNION ALL
  SELECT 'is_canceled', 'not_null', count_if(is_canceled IS NULL) FROM bookings UNION ALL
  SELECT 'is_canceled', 'label_domain',
         count_if(lower(trim(is_canceled)) NOT IN ('0', '1', 'yes', 'no')) FROM bookings)"""
    ),
)
def raw_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: raw booking contract (presence, type class, nullability, ranges, enums, label domain) in one scan."""
    return ck.violation_counts(bookings(spark, sf_dir), ck.raw_booking_contract())


@register(
    "processed_contract_violations",
    with_bookings(
        """
SELECT * FROM (
  SELECT 'y' AS column_name, 'not_null' AS check_name, count_if(y IS NULL) AS n_failed FROM bookings UNION ALL
  SELECT 'y', 'isin', count_if(y NOT IN (0, 1)) FROM bookings UNION ALL
  SELECT 'lead_time', 'numeric', count_if(lead_time IS NULL) FROM bookings UNION ALL
  SELECT 'adults', 'numeric', count_if(adults IS NULL) FROM bookings UNION ALL
  SELECT 'children', 'numeric', count_if(children IS NULL) FROM bookings UNION ALL
  SELECT 'babies', 'numeric', count_if(babies IS NULL) FROM bookings UNION ALL
  SELECT 'adr', 'numeric', count_if(adr IS NULL OR isnan(adr)) FROM bookings UNION ALL
  SELECT 'stays_in_week_nights', 'numeric', count_if(stays_in_week_nights IS NULL) FROM bookings UNION ALL
  SELECT 'stays_in_weekend_nights', 'numeric', count_if(stays_in_weekend_nights IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_year', 'numeric', count_if(arrival_date_year IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_day_of_month', 'numeric', count_if(arrival_date_day_of_month IS NULL) FROM bookings)"""
    ),
)
def processed_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: processed contract — target int in {0,1}, numeric columns parse without NULLs."""
    contract = ck.processed_contract("y", NUMERIC, CATEGORICAL)
    return ck.violation_counts(bookings(spark, sf_dir), contract)


@register(
    "label_domain",
    with_bookings(
        """
SELECT lower(trim(is_canceled)) AS label, count(*) AS n_rows,
       lower(trim(is_canceled)) IN ('0', '1', 'yes', 'no') AS allowed
FROM bookings GROUP BY 1"""
    ),
)
def label_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: distinct normalised labels with counts; offenders are the rows with allowed = false."""
    lab = F.lower(F.trim(F.col("is_canceled").cast("string")))
    return (
        bookings(spark, sf_dir)
        .groupBy(lab.alias("label"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("allowed", F.col("label").isin(list(ck.LABELS)))
    )


@register(
    "record_constraints",
    with_bookings(
        """
SELECT * FROM (
  SELECT 'lead_time' AS column_name, 'range' AS check_name, count_if(lead_time < 0 OR lead_time > 3650) AS n_failed FROM bookings UNION ALL
  SELECT 'adults', 'range', count_if(adults < 1 OR adults > 20) FROM bookings UNION ALL
  SELECT 'children', 'range', count_if(children < 0 OR children > 20) FROM bookings UNION ALL
  SELECT 'babies', 'range', count_if(babies < 0 OR babies > 10) FROM bookings UNION ALL
  SELECT 'stays_in_week_nights', 'range', count_if(stays_in_week_nights < 0 OR stays_in_week_nights > 365) FROM bookings UNION ALL
  SELECT 'stays_in_weekend_nights', 'range', count_if(stays_in_weekend_nights < 0 OR stays_in_weekend_nights > 365) FROM bookings UNION ALL
  SELECT 'adr', 'range', count_if(adr < 0 OR adr > 100000) FROM bookings UNION ALL
  SELECT 'hotel', 'enum', count_if(hotel NOT IN ('Resort Hotel', 'City Hotel')) FROM bookings UNION ALL
  SELECT '*', 'quarantined', count_if(lead_time < 0 OR lead_time > 3650 OR adults < 1 OR adults > 20
      OR children < 0 OR children > 20 OR babies < 0 OR babies > 10
      OR stays_in_week_nights < 0 OR stays_in_week_nights > 365
      OR stays_in_weekend_nights < 0 OR stays_in_weekend_nights > 365
      OR adr < 0 OR adr > 100000 OR hotel NOT IN ('Resort Hotel', 'City Hotel')) FROM bookings)"""
    ),
)
def record_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guest-record constraints (ranges, enums) per rule, plus the quarantined row count."""
    b = bookings(spark, sf_dir)
    contract = ck.guest_record_contract(b.columns)
    counts = ck.violation_counts(b, contract)
    _, bad = ck.split_by_contract(b, contract)
    quarantined = bad.agg(F.count(F.lit(1)).alias("n_failed")).select(
        F.lit("*").alias("column_name"), F.lit("quarantined").alias("check_name"), "n_failed"
    )
    return counts.unionByName(quarantined)


_ANOMALY_CTE = """
t AS (SELECT booking_id,
  coalesce(adults, 0) = 0 AND coalesce(children, 0) = 0 AND coalesce(babies, 0) = 0 AS zero_guests,
  coalesce(adr < -10, false) AS negative_adr,
  coalesce(stays_in_weekend_nights, 0) + coalesce(stays_in_week_nights, 0) > 365 AS extreme_stay,
  coalesce(lead_time > 800, false) AS extreme_lead_time,
  coalesce(adults > 50, false) AS extreme_adults
  FROM bookings)
"""


@register(
    "row_anomaly_counts",
    with_bookings(
        """
SELECT anomaly_type, n FROM (
  SELECT 'zero_guests' AS anomaly_type, count_if(zero_guests) AS n FROM t UNION ALL
  SELECT 'negative_adr', count_if(negative_adr) FROM t UNION ALL
  SELECT 'extreme_stay', count_if(extreme_stay) FROM t UNION ALL
  SELECT 'extreme_lead_time', count_if(extreme_lead_time) FROM t UNION ALL
  SELECT 'extreme_adults', count_if(extreme_adults) FROM t UNION ALL
  SELECT 'n_anomalies', count_if(zero_guests OR negative_adr OR extreme_stay OR extreme_lead_time OR extreme_adults) FROM t)
WHERE n > 0""",
        _ANOMALY_CTE,
    ),
)
def row_anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7/A5: rows hit per anomaly rule (zero-hit rules dropped) and rows hit by any rule, one pass."""
    b = bookings(spark, sf_dir)
    wide = an.row_anomaly_counts(b)
    names = [n for n, _ in an.row_anomaly_rules(b.columns)] + ["n_anomalies"]
    stack = "stack({}, {}) AS (anomaly_type, n)".format(len(names), ", ".join(f"'{n}', `{n}`" for n in names))
    return wide.selectExpr(stack).where("n > 0")


@register(
    "row_anomaly_rows",
    with_bookings(
        """
SELECT booking_id, concat_ws(',',
   CASE WHEN zero_guests THEN 'zero_guests' END, CASE WHEN negative_adr THEN 'negative_adr' END,
   CASE WHEN extreme_stay THEN 'extreme_stay' END, CASE WHEN extreme_lead_time THEN 'extreme_lead_time' END,
   CASE WHEN extreme_adults THEN 'extreme_adults' END) AS anomaly_types
FROM t WHERE zero_guests OR negative_adr OR extreme_stay OR extreme_lead_time OR extreme_adults
ORDER BY booking_id LIMIT 20""",
        _ANOMALY_CTE,
    ),
)
def row_anomaly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 anomalous bookings by key with their rule names (a sample report)."""
    rows = an.anomalous_rows_sample(bookings(spark, sf_dir), "booking_id", 20)
    return rows.select("booking_id", F.concat_ws(",", "anomaly_types").alias("anomaly_types"))


@register(
    "duplicates_full",
    """
SELECT CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates, CAST(sum(c) AS BIGINT) AS n_total,
       round(CAST(sum(c) - count(*) AS DOUBLE) / sum(c), 6) AS duplicate_ratio
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source, n_chars)""",
)
def duplicates_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4/V8: whole-row duplicates of documents without the id (NULLs equal, keep first)."""
    docs = table(spark, sf_dir, "documents").drop("doc_id")
    return an.duplicate_report(docs).withColumn("duplicate_ratio", rnd(F.col("duplicate_ratio")))


@register(
    "duplicates_subset",
    """
SELECT CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates, CAST(sum(c) AS BIGINT) AS n_total,
       round(CAST(sum(c) - count(*) AS DOUBLE) / sum(c), 6) AS duplicate_ratio
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def duplicates_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4/V8: duplicates on the (l_orderkey, l_linenumber) subset of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return an.duplicate_report(li, ["l_orderkey", "l_linenumber"]).withColumn(
        "duplicate_ratio", rnd(F.col("duplicate_ratio"))
    )


_CAT_COLS = ["hotel", "country", "market_segment", "customer_type", "arrival_date_month", "arrival_date_year"]


@register(
    "unseen_categories",
    with_bookings(
        """
SELECT column_name, value, count(*) AS n_rows FROM cur
WHERE (column_name, value) NOT IN (SELECT column_name, value FROM ref)
GROUP BY column_name, value""",
        """
longf AS (SELECT period, column_name, value FROM (
  SELECT period, 'hotel' AS column_name, CAST(hotel AS VARCHAR) AS value FROM bookings UNION ALL
  SELECT period, 'country', CAST(country AS VARCHAR) FROM bookings UNION ALL
  SELECT period, 'market_segment', CAST(market_segment AS VARCHAR) FROM bookings UNION ALL
  SELECT period, 'customer_type', CAST(customer_type AS VARCHAR) FROM bookings UNION ALL
  SELECT period, 'arrival_date_month', CAST(arrival_date_month AS VARCHAR) FROM bookings UNION ALL
  SELECT period, 'arrival_date_year', CAST(arrival_date_year AS VARCHAR) FROM bookings) WHERE value IS NOT NULL),
cur AS (SELECT column_name, value FROM longf WHERE period = 'cur'),
ref AS (SELECT DISTINCT column_name, value FROM longf WHERE period = 'ref')""",
    ),
)
def unseen_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical values of the current period unseen in the reference period, with row counts."""
    b = bookings(spark, sf_dir)
    cur = b.where(F.col("period") == "cur")
    ref = b.where(F.col("period") == "ref")
    unseen = an.unseen_categories(cur, ref, _CAT_COLS)
    counts = an.long_strings(cur, _CAT_COLS).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(unseen, ["column_name", "value"], "left_semi")


@register(
    "output_range",
    with_bookings(
        """
SELECT count(*) AS n_rows, count_if(score IS NULL OR isnan(score)) AS n_nan,
       count_if(NOT isnan(score) AND (score < -1e-6 OR score > 1 + 1e-6)) AS n_out_of_range,
       min(score) AS min_value, max(score) AS max_value,
       count_if(score IS NULL OR isnan(score)) = 0 AND count_if(NOT isnan(score) AND (score < -1e-6 OR score > 1 + 1e-6)) = 0 AS passed
FROM bookings"""
    ),
)
def output_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and out-of-[0,1] counts, min and max of the bookings score."""
    return an.output_range(bookings(spark, sf_dir), "score")


@register(
    "volume_check",
    with_bookings(
        """
SELECT n_cur AS n_rows, greatest(1, CAST(floor(n_ref * (1 - CAST(0.5 AS DOUBLE))) AS BIGINT)) AS expected_low,
       CAST(floor(n_ref * (1 + CAST(0.5 AS DOUBLE))) AS BIGINT) AS expected_high,
       n_cur < greatest(1, CAST(floor(n_ref * (1 - CAST(0.5 AS DOUBLE))) AS BIGINT))
         OR n_cur > CAST(floor(n_ref * (1 + CAST(0.5 AS DOUBLE))) AS BIGINT) AS is_anomalous
FROM (SELECT count_if(period = 'cur') AS n_cur, count_if(period = 'ref') AS n_ref FROM bookings)"""
    ),
)
def volume_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current-period row count within [max(1,⌊n(1−t)⌋), ⌊n(1+t)⌋] of the reference count, t = 0.5."""
    counts = bookings(spark, sf_dir).agg(
        F.count_if(F.col("period") == "cur").alias("n_cur"), F.count_if(F.col("period") == "ref").alias("n_ref")
    )
    t = 0.5
    lo = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_ref") * F.lit(1 - t)).cast("long"))
    hi = F.floor(F.col("n_ref") * F.lit(1 + t)).cast("long")
    return counts.select(
        F.col("n_cur").alias("n_rows"),
        lo.alias("expected_low"),
        hi.alias("expected_high"),
        ((F.col("n_cur") < lo) | (F.col("n_cur") > hi)).alias("is_anomalous"),
    )
