"""Deterministic splits (M1, M2, M5 fold column) by hash order.

Each row gets a 52-bit hash of (key, salt) from MD5 — reproducible in any SQL
engine and exact in a DOUBLE.  The *exact* mode ranks rows inside each class by
(hash, key) with ``grouped_rank`` (range buckets + per-bucket windows, so a
class holding most rows is still spread over many tasks) and cuts at
round(n_class · fraction).  The *hash* mode is a pure filter on
pmod(xxhash64(key, salt), 10⁶) with sizes correct in expectation — zero extra
jobs, for the largest tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.plans.ordering import grouped_rank
from driftwise.sources.files import scratch_path


def hash52(key: Column, salt: str) -> Column:
    """First 13 hex digits of md5(key || salt) as a BIGINT (< 2^52, exact in DOUBLE)."""
    h = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


def class_cut(df: DataFrame, target: str, fraction: float) -> DataFrame:
    """Per class: k = ⌊n·fraction + ½⌋ rows go to the held-out side (tiny table: one row per class)."""
    return df.groupBy(target).agg(F.floor(F.count(F.lit(1)) * F.lit(float(fraction)) + F.lit(0.5)).cast("long").alias("_k"))


def stratified_split(
    df: DataFrame, key: str, target: str, fraction: float, salt: str, mode: str = "exact", out: str = "held_out"
) -> DataFrame:
    """M1: adds boolean ``out`` — True for the held-out share of every class."""
    if mode == "hash":
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1_000_000))
        return df.withColumn(out, bucket < F.lit(int(round(fraction * 1_000_000))))
    if mode != "exact":
        raise ValueError(mode)
    h = "_split_h"
    ranked = grouped_rank(df.withColumn(h, hash52(F.col(key), salt)), [target], h, key, out="_split_rank")
    cuts = class_cut(df, target, fraction)
    # one row per class: a bounded broadcast
    return (
        ranked.join(F.broadcast(cuts), target, "left")
        .withColumn(out, F.col("_split_rank") < F.col("_k"))
        .drop(h, "_split_rank", "_k")
    )


def three_way_split(
    df: DataFrame, key: str, target: str, test_size: float = 0.20, cal_fraction: float = 0.20, seed: int = 42, split_col: str = "split"
) -> DataFrame:
    """M2: test = ``test_size`` of each class; calibration = ``cal_fraction`` of the rest; train = remainder.

    The first cut is written once: the second one reads it several times.
    """
    path = scratch_path(df.sparkSession, "first-cut")
    stratified_split(df, key, target, test_size, f":{seed}", out="_is_test").write.parquet(path)
    first = df.sparkSession.read.parquet(path)
    rest = first.where(~F.col("_is_test")).drop("_is_test")
    test = first.where(F.col("_is_test")).drop("_is_test").withColumn(split_col, F.lit("test"))
    second = stratified_split(rest, key, target, cal_fraction, f":{seed + 1}", out="_is_cal")
    tc = second.withColumn(split_col, F.when(F.col("_is_cal"), F.lit("cal")).otherwise(F.lit("train"))).drop("_is_cal")
    return tc.unionByName(test)


def kfold(df: DataFrame, key: str, target: str, k: int = 5, salt: str = ":7", fold_col: str = "fold") -> DataFrame:
    """M5 fold column: stratified, fold = (rank inside class by hash) mod k, so fold sizes differ by ≤ 1 per class."""
    h = "_fold_h"
    ranked = grouped_rank(df.withColumn(h, hash52(F.col(key), salt)), [target], h, key, out="_fold_rank")
    return ranked.withColumn(fold_col, (F.col("_fold_rank") % F.lit(k)).cast("int")).drop(h, "_fold_rank")


def split_summary(df: DataFrame, split_col: str, target: str, key: str) -> DataFrame:
    """Per split size, positive rate and a key checksum."""
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
        F.sum(F.col(key).cast("long")).alias("key_sum"),
    )


def expected_sizes(n: int, test_size: float = 0.20, cal_fraction: float = 0.20) -> dict[str, int]:
    """V14 expectations for the three-way plan (whole-table rounding)."""
    test = int((n * test_size) + 0.5)
    cal = int(((n - test) * cal_fraction) + 0.5)
    return {"test": test, "cal": cal, "train": n - test - cal}

