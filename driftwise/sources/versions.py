"""A keyed table that changes by whole versions.

A change set is merged into the table in one full outer join and written as a new version; a pointer file that names the
version is then replaced by one atomic rename.  A reader resolves the pointer once, so it sees either the old or the new
version, whole.  A job that dies before the rename leaves the old version in force and may simply be run again.  One
writer at a time is assumed; a writer that merged into a version no longer in force is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def merge_changes(base: DataFrame, changes: DataFrame, key: str, active: str = "is_active", stale: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``base`` after ``changes(key, op, seq, fields...)``, applied per key in the order of ``seq``.

    ``insert`` adds a row, active unless it says otherwise; it is refused (changes nothing) where the key exists.
    ``update`` sets the fields that are not null; ``delete`` clears ``active`` and keeps the row; ``purge`` takes the row
    out, whatever else the set holds for its key.  Updates and deletes of a key that does not exist (yet) do nothing.
    ``stale`` names columns that are set to null when one of their source columns changes, e.g. an embedding and its text.
    Changes without a key or with another op do nothing; equal ``seq`` of one key: the greatest value wins.
    Columns of ``base`` that ``changes`` lacks are kept, and null in inserted rows.
    """
    fields = [c for c in base.columns if c != key and (c in changes.columns or c == active)]
    op = F.col("op")

    def changed(c: str) -> Column:
        own = F.col(c) if c in changes.columns else F.lit(None).cast(base.schema[c].dataType)
        return F.when(op == "delete", F.lit(False)).otherwise(own) if c == active else own

    aggs = []
    for c in fields:  # the last value an update gives it; a delete gives one to the active flag only
        sets = (op == "update") | (op == "delete") if c == active else op == "update"
        value = F.when(sets & changed(c).isNotNull(), F.struct(F.col("seq").alias("at"), changed(c).alias("v")))
        aggs += [F.max(value).alias(f"__last_{c}")]
    first = F.min(F.when(op == "insert", F.struct("seq", *[changed(c).alias(c) for c in fields]))).alias("__insert")
    known = changes.filter(F.col(key).isNotNull() & op.isin("insert", "update", "delete", "purge"))
    by_key = known.groupBy(F.col(key).alias("__key")).agg(first, *aggs, F.bool_or(op == "purge").alias("__purge"))

    rows = base.withColumn("__here", F.lit(True)).join(by_key, F.col(key) == F.col("__key"), "full_outer")
    rows = rows.filter((F.col("__here") | F.col("__insert").isNotNull()) & ~F.coalesce("__purge", F.lit(False)))
    here = F.coalesce("__here", F.lit(False))

    def merged(c: str) -> Column:
        last, old = F.col(f"__last_{c}"), F.when(here, F.col(c)).otherwise(F.col(f"__insert.{c}"))
        if c == active:
            old = F.when(here, F.col(c)).otherwise(F.coalesce(F.col(f"__insert.{c}"), F.lit(True)))
        return F.when(last.isNotNull() & (here | (last["at"] > F.col("__insert.seq"))), last["v"]).otherwise(old)

    out = {c: merged(c) for c in fields} | {key: F.coalesce(key, "__key")}
    for c, sources in (stale or {}).items():
        moved = F.lit(False)
        for s in sources:
            moved = moved | (here & ~merged(s).eqNullSafe(F.col(s)))
        out[c] = F.when(~moved, out.get(c, F.col(c)))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in base.columns])


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the version in force; None before the first."""
    path, fs = _path(spark, f"{root}/{POINTER}")
    if not fs.exists(path):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The table as of ``version`` (default: the one in force when this is called)."""
    name = version or current_version(spark, root)
    if name is None:
        raise FileNotFoundError(f"no version of {root} is in force")
    return spark.read.parquet(f"{root}/{name}")


def write_version(df: DataFrame, root: str, based_on: str | None = None) -> str:
    """Write ``df`` as a new version and put it in force; ``based_on`` is the version it was made from."""
    spark = df.sparkSession
    name = f"version-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{root}/{name}")
    if current_version(spark, root) != based_on:
        raise RuntimeError(f"another version of {root} came into force meanwhile; merge again")
    draft, fs = _path(spark, f"{root}/.{POINTER}-{name}")
    out = fs.create(draft, False)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(overwrite, 1)
    how[0] = overwrite.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, _path(spark, f"{root}/{POINTER}")[0], how)
    return name


def merge_version(spark: SparkSession, root: str, changes: DataFrame, key: str, **options) -> str:
    """Merge ``changes`` into the version in force and put the result in force."""
    name = current_version(spark, root)
    return write_version(merge_changes(read_version(spark, root, name), changes, key, **options), root, based_on=name)


def _path(spark: SparkSession, path: str):
    raw = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = raw.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(raw), fs
