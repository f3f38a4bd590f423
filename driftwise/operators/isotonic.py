"""M9: isotonic calibration as pool-adjacent-violators over mergeable block summaries.

Equal scores are one weighted point.  Points are dealt into blocks by score, and each block pools its own violators; a pool
of a block is always part of one pool of the whole, so pools stand for their points from then on.  Blocks are dealt anew,
shifted by half a block, until no two neighbours violate the order across an edge.  No task sees more than about a block,
and nothing but the edges of the blocks reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise.plans.ordering import bucketize
from driftwise.sources.files import scratch_path

#: Pools, and rows to calibrate, that a task is planned for.
BLOCK_ROWS = 50_000

_POOL = "_b int, lo double, hi double, w double, s double"


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "pools")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(pools: DataFrame, n: int, block_rows: int, shift: float) -> tuple[DataFrame, list[float]]:
    """Pools with their block ``_b``, and the edges between blocks (lower ends of pools)."""
    bins = math.ceil(n / block_rows)
    probs = [(i + shift) / bins for i in range(bins) if 0 < (i + shift) / bins < 1]
    edges = sorted(set(pools.approxQuantile("lo", probs, 1 / (8 * bins)))) if bins > 1 else []
    return _in_blocks(pools, "lo", edges), edges


def _in_blocks(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    return bucketize(df, col, edges, "_b") if edges else df.withColumn("_b", F.lit(0))


def _pool(t: pa.Table) -> pa.Table:
    """Pool the violators of one block: neighbours whose means do not rise become one pool."""
    t = t.sort_by("lo")
    lo, hi, w, s = (t[c].to_pylist() for c in ("lo", "hi", "w", "s"))
    out: list[list[float]] = []
    for row in zip(lo, hi, w, s):
        out.append(list(row))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, top, weight, total = out.pop()
            out[-1][1] = top
            out[-1][2] += weight
            out[-1][3] += total
    cols = list(zip(*out)) if out else [()] * 4
    return pa.table({"_b": pa.array([t["_b"][0].as_py()] * len(out), pa.int32()), **{c: pa.array(v, pa.float64()) for c, v in zip(("lo", "hi", "w", "s"), cols)}})


def _block_ends(pools: DataFrame) -> DataFrame:
    """One row a block: its first point and the means at both ends, beside those of the block before."""
    mean = F.col("s") / F.col("w")
    ends = pools.groupBy("_b").agg(F.min(F.struct("lo", mean.alias("v"))).alias("first"), F.max(F.struct("lo", mean.alias("v"))).alias("last"))
    before = Window.orderBy("_b")  # as many rows as blocks
    return ends.select("first", F.lag("_b").over(before).alias("b_before"), F.lag("last").over(before).alias("last_before"))


def fit_isotonic(cal: DataFrame, score: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pools ``(lo, hi, value)`` of the least-squares rising fit of ``label`` on ``score``; values rise strictly with ``lo``.

    Rows without a finite score or a label take no part; no row gives no pool.
    """
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    rows = cal.select(x.alias("lo"), y.alias("y")).filter(F.col("y").isNotNull() & ~F.isnan("y") & ~F.isnan("lo") & (F.abs("lo") < float("inf")))
    pools = _written(rows.groupBy("lo").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").alias("s")).select("lo", F.col("lo").alias("hi"), "w", "s"))
    shift = 0.0
    while n := pools.count():
        dealt, edges = _dealt(pools.select("lo", "hi", "w", "s"), n, block_rows, shift)
        pools = _written(dealt.groupBy("_b").applyInArrow(_pool, _POOL))
        if not edges or _block_ends(pools).filter("last_before.v >= first.v").isEmpty():
            break
        shift = 0.5 - shift
    return pools.select("lo", "hi", (F.col("s") / F.col("w")).alias("value"))


def apply_isotonic(df: DataFrame, pools: DataFrame, score: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``out``: the pool's value within a pool, a straight line between two pools, the end values beyond them.

    Null or NaN scores, and all scores where there is no pool, get null.  Scores meet the pools of their block; a block
    that holds many scores is cut by source partition, its pools go to every cut.
    """
    x = F.col(f"`{score}`").cast("double")
    missing = x.isNull() | F.isnan(x)
    n = pools.count()
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))
    dealt, edges = _dealt(pools.select("lo", "hi", F.lit(1.0).alias("w"), F.col("value").alias("s")), n, block_rows, 0.0)
    after = _block_ends(dealt).filter("b_before is not null").select(
        F.col("first.lo").alias("lo"), F.col("first.lo").alias("hi"), F.col("first.v").alias("s"), F.col("b_before").alias("_b"))
    curve = dealt.select("lo", "hi", "s", "_b").unionByName(after)

    rows = df.filter(~missing).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), x.alias("_x"))
    rows = _in_blocks(rows, "_x", edges)
    cuts = rows.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_cuts"))  # one row a block
    rows = rows.join(F.broadcast(cuts), "_b").withColumn("_cut", F.pmod(F.spark_partition_id(), "_cuts"))
    curve = curve.join(F.broadcast(cuts), "_b").withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))

    def interpolate(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("lo")
        at = np.stack([right["lo"].to_numpy(), right["hi"].to_numpy()], 1).ravel()
        return pa.table({"_row": left["_row"], "_y": pa.array(np.interp(left["_x"].to_numpy(), at, np.repeat(right["s"].to_numpy(), 2)))})

    fitted = rows.select("_row", "_x", "_b", "_cut").groupBy("_b", "_cut").cogroup(curve.groupBy("_b", "_cut"))
    row_type = rows.schema["_row"].dataType.simpleString()
    done = fitted.applyInArrow(interpolate, f"_row {row_type}, _y double").select("_row.*", F.col("_y").alias("_fitted"))
    return done.unionByName(df.filter(missing).withColumn("_fitted", F.lit(None).cast("double"))).withColumn(out, F.col("_fitted")).drop("_fitted")
