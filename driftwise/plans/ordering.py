"""Order statistics without a one-task window.

Three shared physical patterns used across the library:

* ``global_prefix_sum`` — running sums in a global order.  Rows are assigned to
  range buckets whose edges come from ``approxQuantile`` (balanced over the input
  rows), a window runs *per bucket*, and per-bucket totals (one row per bucket,
  a proven-bounded table) supply the offsets.  No ``Window.orderBy`` without a
  ``partitionBy`` ever touches the data itself.
* ``order_statistics`` — exact k-th smallest values by histogram refinement:
  approximate edges → exact counts per bucket → recurse into the bucket that
  holds the wanted rank until its distinct values fit a bounded driver list.
  Each round cuts the candidate range by ~``n_bins``; a bucket holding one hot
  value resolves at once.  Used for exact medians / quantiles (Spark's exact
  ``percentile`` keeps every distinct value of a group in one buffer).
* ``top_k_filter`` — exact capacity top-k by (score desc, key asc) expressed as
  a filter ``score > s* OR (score = s* AND key <= k*)``; the cut-off pair is
  found with ``order_statistics``.  No global sort and no single-task window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Largest list of (value, count) pairs ever brought to the driver in one round.
MAX_LOCAL_DISTINCT = 100_000


def default_bins(df: DataFrame) -> int:
    try:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always set in practice
        parts = 200
    return max(64, 4 * parts)


def _splits(edges: Sequence[float]) -> list[float]:
    inner = sorted({float(e) for e in edges if e is not None and not math.isnan(e) and not math.isinf(e)})
    return [-math.inf, *inner, math.inf]


def bucketize(df: DataFrame, col: str, edges: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Bucket id = number of edges <= value (binary search inside the JVM)."""
    splits = _splits(edges)
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def global_prefix_sum(
    df: DataFrame,
    order_col: str,
    value_cols: Sequence[str],
    descending: bool = False,
    n_buckets: int | None = None,
    prefix: str = "cum_",
    group_cols: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    how: str = "sum",
) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in the order of ``order_col`` (within ``group_cols``).

    Ties on ``order_col`` are ordered by ``tiebreak`` columns (give a key for a
    deterministic order; collapse ties with ``groupBy`` first when they should
    share one value).  Output keeps every input column and adds
    ``{prefix}{v}`` per value column.  Range buckets come from quantiles of the
    order column over all rows, so a large group is spread over many window
    partitions; per-(group, bucket) totals supply the offsets.
    """
    n_buckets = n_buckets or default_bins(df)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    key = "_pfx_key"
    groups = list(group_cols)
    work = df.withColumn(key, F.col(order_col).cast("double"))
    if descending:
        work = work.withColumn(key, -F.col(key))
    edges = work.approxQuantile(key, probs, 1.0 / (4 * n_buckets)) if probs else []
    work = bucketize(work, key, edges, "_pfx_b")
    order = [F.col(key)] + [F.col(t) for t in tiebreak]
    inner = Window.partitionBy(*groups, "_pfx_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if how not in ("sum", "max"):
        raise ValueError(how)
    agg = F.sum if how == "sum" else F.max
    for v in value_cols:
        work = work.withColumn(f"_pfx_run_{v}", agg(v).over(inner))
    totals = work.groupBy(*groups, "_pfx_b").agg(*[agg(v).alias(f"_pfx_tot_{v}") for v in value_cols])
    # one row per (group, bucket): the offset window only sees that small table
    before = Window.partitionBy(*groups).orderBy("_pfx_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_pfx_b",
        *[(F.coalesce(agg(f"_pfx_tot_{v}").over(before), F.lit(0)) if how == "sum" else agg(f"_pfx_tot_{v}").over(before)).alias(f"_pfx_off_{v}")
          for v in value_cols],
    )
    if not groups:
        offsets = F.broadcast(offsets)  # at most n_buckets rows
    out = work.join(offsets, [*groups, "_pfx_b"])
    for v in value_cols:
        run, off = F.col(f"_pfx_run_{v}"), F.col(f"_pfx_off_{v}")
        out = out.withColumn(f"{prefix}{v}", run + off if how == "sum" else F.greatest(run, off))
    drop = [key, "_pfx_b"] + [c for v in value_cols for c in (f"_pfx_run_{v}", f"_pfx_off_{v}")]
    return out.drop(*drop)


def grouped_rank(
    df: DataFrame, group_cols: Sequence[str], order_col: str, key_col: str, out: str = "rank"
) -> DataFrame:
    """0-based rank of each row inside its group by (order_col asc, key asc) — no per-group window."""
    work = df.withColumn("_gr_one", F.lit(1))
    ranked = global_prefix_sum(work, order_col, ["_gr_one"], group_cols=group_cols, tiebreak=[key_col], prefix="_gr_cum")
    return ranked.withColumn(out, (F.col("_gr_cum_gr_one") - 1).cast("long")).drop("_gr_one", "_gr_cum_gr_one")


def order_statistics(
    df: DataFrame,
    col: str,
    ranks: Sequence[int],
    n_bins: int | None = None,
    max_local: int = MAX_LOCAL_DISTINCT,
) -> dict[int, float]:
    """Exact 0-based ascending order statistics of the non-null, non-NaN values of ``col``."""
    n_bins = n_bins or default_bins(df)
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    # several passes read the same single column: keep it (lineage is deterministic, so a lost block is recomputed)
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _refine(x, ranks, n_bins, max_local)
    finally:
        x.unpersist()


def _refine(x: DataFrame, ranks: Sequence[int], n_bins: int, max_local: int) -> dict[int, float]:
    # state per wanted rank: (lo, hi, rank within [lo, hi))
    pending: dict[int, tuple[float, float, int]] = {int(r): (-math.inf, math.inf, int(r)) for r in ranks}
    result: dict[int, float] = {}
    stalled: set[int] = set()
    while pending:
        groups: dict[tuple[float, float], list[int]] = {}
        for r, (lo, hi, _) in pending.items():
            groups.setdefault((lo, hi), []).append(r)
        next_pending: dict[int, tuple[float, float, int]] = {}
        for (lo, hi), rs in groups.items():
            sub = x
            if lo != -math.inf:
                sub = sub.where(F.col("x") >= F.lit(lo))
            if hi != math.inf:
                sub = sub.where(F.col("x") < F.lit(hi))
            stats = sub.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("x", 0.05).alias("d")).first()
            stuck = any(pending[r][0:2] == (lo, hi) and r in stalled for r in rs)
            if stats["d"] <= max_local // 2 or stuck:
                rows = sub.groupBy("x").count().orderBy("x").collect()
                cum = 0
                bounds = []
                for row in rows:
                    bounds.append((cum, cum + row["count"], row["x"]))
                    cum += row["count"]
                for r in rs:
                    want = pending[r][2]
                    for a, b, v in bounds:
                        if a <= want < b:
                            result[r] = v
                            break
                    else:
                        raise ValueError(f"rank {r} outside of data ({cum} values)")
                continue
            probs = [i / n_bins for i in range(1, n_bins)]
            edges = sorted(set(sub.approxQuantile("x", probs, 1.0 / (4 * n_bins))))
            hist = (
                bucketize(sub, "x", edges, "b")
                .groupBy("b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                .orderBy("b")
                .collect()
            )
            splits = _splits(edges)
            cum = 0
            spans = []
            for row in hist:
                b = row["b"]
                spans.append((cum, cum + row["n"], max(lo, splits[b]), min(hi, splits[b + 1]), row["mn"], row["mx"]))
                cum += row["n"]
            for r in rs:
                want = pending[r][2]
                for a, b, blo, bhi, mn, mx in spans:
                    if a <= want < b:
                        if mn == mx:
                            result[r] = mn
                        else:
                            if b - a == stats["n"]:
                                stalled.add(r)  # edges did not split the range
                            next_pending[r] = (blo, bhi, want - a)
                        break
                else:
                    raise ValueError(f"rank {r} outside of data ({cum} values)")
        pending = next_pending
    return result


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], n: int | None = None) -> list[float | None]:
    """Linear-interpolation quantiles (numpy default, DuckDB ``quantile_cont``)."""
    if n is None:
        n = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).count()
    if n == 0:
        return [None for _ in probs]
    wanted = set()
    hs = []
    for p in probs:
        h = (n - 1) * float(p)
        lo, hi = math.floor(h), math.ceil(h)
        wanted.update((lo, hi))
        hs.append((h, lo, hi))
    stats = order_statistics(df, col, sorted(wanted))
    out = []
    for h, lo, hi in hs:
        a, b = stats[lo], stats[hi]
        out.append(a + (h - lo) * (b - a))
    return out


def element_at_rank(df: DataFrame, col: str, rank: int, n_parts: int = 32, max_local: int = MAX_LOCAL_DISTINCT):
    """The value of 0-based ascending ``rank`` among the non-null values of ``col``, in the column's own type.

    Each round deals the open range by value over ``n_parts`` partitions and keeps the one that holds the rank; only
    (minimum, maximum, count) of each partition reach the driver.  A range that its sample cannot split gives up its
    smallest value, however often that occurs.
    """
    x = df.select(F.col(col).alias("x")).where(F.col("x").isNotNull())
    while True:
        ranged = x.repartitionByRange(n_parts, "x").groupBy(F.spark_partition_id().alias("p")).agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
        spans = sorted(ranged.collect(), key=lambda r: r["lo"])
        for r in spans:
            if rank < r["n"]:
                break
            rank -= r["n"]
        else:
            raise ValueError(f"rank lies {rank + 1} values beyond the data")
        if r["lo"] == r["hi"]:
            return r["lo"]
        x = x.where((F.col("x") >= F.lit(r["lo"])) & (F.col("x") <= F.lit(r["hi"])))
        if r["n"] <= max_local:
            return sorted(v["x"] for v in x.collect())[rank]
        if len(spans) == 1:
            least = x.where(F.col("x") == F.lit(r["lo"])).count()
            if rank < least:
                return r["lo"]
            rank -= least
            x = x.where(F.col("x") > F.lit(r["lo"]))


def top_k_predicate(df: DataFrame, score: str, key: str, k: int):
    """Condition that the k rows of ``df`` with the largest (score, then smallest key; null keys first) meet.

    NULL and NaN scores never do.  Rows equal in score and key stand or fall together.
    """
    sc = F.col(score).cast("double")
    ranked = sc.isNotNull() & ~F.isnan(sc)
    if k <= 0:
        return F.lit(False)
    cand = df.where(ranked).select(score, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = cand.count()
        if k >= n:
            return ranked
        s_star = order_statistics(cand, score, [n - k])[n - k]
        need = k - cand.where(sc > F.lit(s_star)).count()
        ties = cand.where(sc == F.lit(s_star))
        nulls = ties.where(F.col(key).isNull()).count()
        among = F.col(key).isNull() if nulls else F.lit(False)
        if need > nulls:
            among = among | (F.col(key) <= F.lit(element_at_rank(ties, key, need - nulls - 1)))
    finally:
        cand.unpersist()
    return F.coalesce(ranked & ((sc > F.lit(s_star)) | ((sc == F.lit(s_star)) & among)), F.lit(False))


def top_k_filter(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Rows ranked 1..k by (score desc, key asc), as a pure filter on ``df``."""
    return df.where(top_k_predicate(df, score, key, k))


def _linear_from_sorted(pairs: list[tuple[float, int]], n: int, probs: Sequence[float]) -> list[float]:
    """Quantiles from sorted (value, count) pairs covering all n values."""
    out = []
    for p in probs:
        h = (n - 1) * float(p)
        lo, hi = math.floor(h), math.ceil(h)
        vals = {}
        cum = 0
        for v, c in pairs:
            for r in (lo, hi):
                if r not in vals and cum <= r < cum + c:
                    vals[r] = v
            cum += c
            if lo in vals and hi in vals:
                break
        a, b = vals[lo], vals[hi]
        out.append(a + (h - lo) * (b - a))
    return out


def exact_quantiles_many(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    counts: dict[str, int] | None = None,
    approx_distinct: dict[str, int] | None = None,
    max_local: int = MAX_LOCAL_DISTINCT,
) -> dict[str, list[float | None]]:
    """Exact linear quantiles for many numeric columns with a fixed number of jobs.

    Columns with few distinct values resolve together from one grouped count
    of the long form (bounded: at most ``max_local/2`` pairs per column); the
    others go through ``exact_quantiles`` (histogram refinement).
    """
    if not cols:
        return {}
    df = df.select(*[F.col(f"`{c}`") for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles_many(df, cols, probs, counts, approx_distinct, max_local)
    finally:
        df.unpersist()


def _quantiles_many(df, cols, probs, counts, approx_distinct, max_local):
    if counts is None or approx_distinct is None:
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            ok = F.when(~F.isnan(x), x)
            aggs += [F.count(ok).alias(f"{c}__n"), F.approx_count_distinct(ok, 0.05).alias(f"{c}__d")]
        row = df.agg(*aggs).first()
        counts = {c: row[f"{c}__n"] for c in cols}
        approx_distinct = {c: row[f"{c}__d"] for c in cols}
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols if counts[c] == 0}
    small = [c for c in cols if counts[c] > 0 and approx_distinct[c] <= max_local // 2]
    big = [c for c in cols if counts[c] > 0 and c not in small]
    if small:
        casts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in small)
        long = df.selectExpr(f"stack({len(small)}, {casts}) AS (column_name, x)").where("x IS NOT NULL AND NOT isnan(x)")
        rows = long.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("c")).collect()
        per: dict[str, list[tuple[float, int]]] = {c: [] for c in small}
        for row in rows:
            per[row["column_name"]].append((row["x"], row["c"]))
        for c in small:
            pairs = sorted(per[c])
            result[c] = _linear_from_sorted(pairs, counts[c], probs)
    for c in big:
        result[c] = exact_quantiles(df, c, probs, n=counts[c])
    return result
