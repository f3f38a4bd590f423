"""Readers for the star-schema test tables and the ``bookings`` proxy view.

Every reader goes through ``spark.read.parquet`` so that column pruning and
filter pushdown reach the scan.  Parquet timestamps written without a zone load
as TIMESTAMP_NTZ; they stay that type in batch jobs (streaming casts them).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# bookings views materialised for the duration of a multi-pass job (sf_dir → DataFrame over written Parquet)
_MATERIALIZED: dict[str, DataFrame] = {}


@contextmanager
def materialized_bookings(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """Write the bookings view once to the shared scratch folder and serve it to every ``bookings()`` call
    made while the context is open.

    Multi-pass jobs (quantile refinement, capacity cut-offs, several reports)
    then re-read a narrow Parquet table instead of re-aggregating lineitem on
    every pass; the written table also cuts the lineage, so a lost executor
    recomputes from it rather than from the raw tables.
    """
    if sf_dir in _MATERIALIZED:
        yield _MATERIALIZED[sf_dir]
        return
    from driftwise.sources.files import scratch_path

    path = scratch_path(spark, "bookings")
    bookings(spark, sf_dir).write.mode("overwrite").parquet(path)
    _MATERIALIZED[sf_dir] = spark.read.parquet(path)
    try:
        yield _MATERIALIZED[sf_dir]
    finally:
        _MATERIALIZED.pop(sf_dir, None)


def bookings(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Booking-shaped proxy over orders ⨝ customer ⨝ nation ⟕ per-order line stats.

    One row per order (``booking_id`` unique).  ``orders`` may be a streaming
    DataFrame: the other inputs are static, so this becomes a stream–static join.  Orders without lines keep NULL
    ``adults``/``children``/``babies``/``adr``.  The line stats aggregate is a
    partial+final hash aggregate keyed by ``l_orderkey``; the join to orders is on
    the same key, so at scale AQE keeps it a co-partitioned sort-merge join while
    customer (O(orders/10)) and nation (25 rows) are joined by key as usual.
    """
    if orders is None and sf_dir in _MATERIALIZED:
        return _MATERIALIZED[sf_dir]
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.sum("l_extendedprice").alias("price"),
            F.max("l_linenumber").alias("max_line"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
        )
    )
    orders = orders if orders is not None else table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ok = F.col("o_orderkey")
    months = "JanFebMarAprMayJunJulAugSepOctNovDec"
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(li, ok == F.col("l_orderkey"), "left")
        .select(
            ok.alias("booking_id"),
            F.col("o_orderdate").cast("date").alias("booked_on"),
            F.when(F.col("o_orderdate") < F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"), "ref")
            .otherwise("cur")
            .alias("period"),
            F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("is_canceled"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Resort Hotel")
            .otherwise("City Hotel")
            .alias("hotel"),
            F.year("o_orderdate").alias("arrival_date_year"),
            F.substring(F.lit(months), 3 * F.month("o_orderdate") - 2, 3).alias("arrival_date_month"),
            F.dayofmonth("o_orderdate").alias("arrival_date_day_of_month"),
            ((ok * 37) % 907).cast("int").alias("lead_time"),
            F.col("n_lines").cast("int").alias("adults"),
            F.col("n_ret").cast("int").alias("children"),
            (F.col("max_line") % 2).cast("int").alias("babies"),
            ((ok * 13) % 11).cast("int").alias("stays_in_week_nights"),
            ((ok * 7) % 4).cast("int").alias("stays_in_weekend_nights"),
            (F.col("price") / F.col("qty")).alias("adr"),
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("market_segment"),
            F.col("o_orderpriority").alias("customer_type"),
            (((ok * 7919) % 10007).cast("double") / F.lit(10007.0)).alias("score"),
        )
    )


def bookings_period(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    return bookings(spark, sf_dir).where(F.col("period") == period)
