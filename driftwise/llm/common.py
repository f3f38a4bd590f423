"""Helpers shared by the operators: scratch tables, skew-safe joins, row selection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.session import ensure_checkpoint_dir

#: A key is hot when it holds at least this share of all rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the written table (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def lookup(rows: DataFrame, facts: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row of ``facts`` per key value, safe for hot keys.

    ``facts[count]`` is the number of rows of the key.  Keys with at least ``HOT_SHARE`` of ``total`` rows number at
    most 1 / HOT_SHARE by that definition, so they are broadcast; every other key is joined by shuffle.  ``key``
    columns are not null.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = facts.filter(F.col(count) >= least)
    rest = facts.filter(F.col(count) < least)
    marked = rows.join(F.broadcast(hot.select(*key, F.lit(True).alias("__hot"))), key, "left")
    a = marked.filter("__hot").drop("__hot").join(F.broadcast(hot), key, "left")
    b = marked.filter("__hot is null").drop("__hot").join(rest, key, "left")
    return a.unionByName(b)


def keep_rows(docs: DataFrame, winners: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` named by ``winners`` (``__id``, ``__sha`` binary SHA-256 of the text, ``__n`` rows that repeat both).

    Rows that repeat both id and text come out once.  All columns of ``docs`` pass unchanged.
    """
    marked = packed(docs).select("__row", F.col(f"__row.`{id_col}`").cast("long").alias("__id"), sha_bytes(f"__row.`{text_col}`").alias("__sha"))

    def kept(by: DataFrame) -> DataFrame:
        by = by.select(F.col("__id").alias("__own"), F.col("__sha").alias("__text"))
        return marked.join(by, marked["__id"].eqNullSafe(by["__own"]) & (marked["__sha"] == by["__text"]), "left_semi")

    if winners.filter("__n > 1").isEmpty():
        return kept(winners).select("__row.*")
    again = kept(winners.filter("__n > 1")).dropDuplicates(["__id", "__sha"])
    return kept(winners.filter("__n = 1")).unionByName(again).select("__row.*")


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct ``__row``, so that no helper column can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def sha_bytes(text_col: str) -> Column:
    return F.unhex(F.sha2(text_bytes(text_col), 256))
