"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words.  ``target / size`` splits into whole copies of every document and one more
copy with a fractional inclusion probability.  The cube method makes those probabilities 0 or 1 while it holds two
balances of the source: the words and the number of documents taken.  The flight phase moves three probabilities at
a time along the null space of the two constraints until one of them is fixed; it runs block by block, then over the
few units that blocks leave, level by level.  The landing phase sets the last few units of a source to the 0/1
choice nearest to the balances.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import packed, stored, text_bytes

#: Units that one flight block is planned for.
BLOCK_UNITS = 2_000
#: Units that the landing phase decides together, beside the two that the flight leaves.
LANDING_UNITS = 12
MAX_COPIES = 3
EPS = 1e-9


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bytes.split() cuts at the six ASCII white space characters, as ``[^\\x20\\x09-\\x0D]+`` does."""
    for batch in batches:
        *rest, text = batch.columns
        n = pa.array([len(t.as_py().split()) for t in text], pa.int64())
        yield pa.RecordBatch.from_arrays([*rest, n], names=[*batch.schema.names[:-1], "size"])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(__id long, __source string, __tie long, size long)`` per row; ``__tie`` orders rows that share an id."""
    return docs.select(
        F.col(id_col).cast("long").alias("__id"), F.col(source_col).cast("string").alias("__source"),
        F.xxhash64(text_bytes(text_col)).alias("__tie"), text_bytes(text_col).alias("text"),
    ).mapInArrow(count_words, "__id long, __source string, __tie long, size long")


def source_targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: ``__source, source_size, n, target``.

    Sources in code-point order (null last) take the weights in turn and share all words in proportion.  A target
    stops at MAX_COPIES times its source's size and the excess goes to the others by weight.  With sources ordered by
    that limit over weight the stopped ones are a leading run, so running sums decide it without iterating.  The
    windows run over one row per source, not over documents.
    """
    per = rows.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.encode(F.col("__source"), "utf-8").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    per = per.withColumns({"weight": F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn),
                           "limit": F.lit(float(MAX_COPIES)) * F.col("source_size")})
    run = Window.orderBy(F.col("limit") / F.col("weight"), "__source")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    onward = run.rowsBetween(0, Window.unboundedFollowing)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    per = per.withColumns({"rank": F.row_number().over(run), "level": left / F.sum("weight").over(onward)})
    per = per.withColumn("stopped", F.col("level") * F.col("weight") >= F.col("limit"))
    level = F.min(F.when(~F.col("stopped"), F.struct("rank", "level"))).over(whole)["level"]
    return per.select("__source", "source_size", "n",
                      F.when(F.col("stopped"), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def flight(units: list[list], rng: random.Random, land: bool) -> None:
    """Cube method on units ``[p, size]`` in place: every p becomes 0 or 1, but for two at most if not ``land``.

    Constraints: the sums of p * size and of p stay as they are.  With sizes a, b, c of three open units the null
    space of ((a, b, c), (1, 1, 1)) is spanned by (b - c, c - a, a - b); equal sizes allow any move that sums to zero.
    The step to either wall is drawn so that each p keeps its expectation.
    """
    held = max(0, len(units) - LANDING_UNITS) if land else len(units)
    open_: list[list] = []
    for x in units[:held]:
        if EPS < x[0] < 1 - EPS:
            open_.append(x)
        else:
            x[0] = float(round(x[0]))
        if len(open_) == 3:
            a, b, c = open_
            va, vb, vc = b[1] - c[1], c[1] - a[1], a[1] - b[1]
            if not (va or vb or vc):
                va, vb, vc = 1, -1, 0
            _step(((a, va), (b, vb), (c, vc)), rng.random())
            open_ = [y for y in open_ if 0.0 < y[0] < 1.0]
    if land:
        _land(open_ + units[held:])


def _step(moves, u: float) -> None:
    up = min(((1 - x[0]) / v if v > 0 else x[0] / -v) for x, v in moves if v)
    down = min((x[0] / v if v > 0 else (1 - x[0]) / -v) for x, v in moves if v)
    step = up if u * (up + down) < down else -down
    for x, v in moves:
        p = x[0] + step * v
        x[0] = 0.0 if p <= EPS else 1.0 if p >= 1 - EPS else p


def _land(rest: list[list]) -> None:
    """Of all 0/1 choices for the few units left, the one nearest to both balances (words first)."""
    if not rest:
        return
    p, size = np.array([x[0] for x in rest]), np.array([x[1] for x in rest], float)
    takes = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    off = np.abs(takes @ size - p @ size) / max(size.mean(), 1.0) + 0.1 * np.abs(takes.sum(axis=1) - p.sum())
    for x, take in zip(rest, takes[np.argmin(off)]):
        x[0] = float(take)


_UNITS = "__group string, __id long, __tie long, __dup long, size long, p double, __n long"


def _fly(seed: int, level: int):
    def run(key: tuple[pa.Scalar, ...], units: pa.Table) -> pa.Table:
        units = units.sort_by([(c, "ascending") for c in ("__order", "__id", "__tie", "__dup")])
        cells = [[p, s] for p, s in zip(units["p"].to_pylist(), units["size"].to_pylist())]
        flight(cells, random.Random(f"{seed}:{level}:{key[0].as_py()}:{key[1].as_py()}"), units["__land"][0].as_py())
        out = units.set_column(units.schema.get_field_index("p"), "p", pa.array([x[0] for x in cells], pa.float64()))
        return out.select(["__group", "__id", "__tie", "__dup", "size", "p", "__n"])

    return run


def balanced_sample(units: DataFrame, seed: int = 0) -> DataFrame:
    """Cube sample of ``(__group, __id, __tie, __dup, size, p, __n)`` balanced on words and documents of each group.

    ``__n`` is the number of rows of the group (or more).  Returns the same rows with p 0 or 1.  Blocks are cut by a
    hash of the row's key, so reruns agree however the rows are partitioned, and rows are dealt by group and block.
    Each level leaves two units of a block at most, so the next one has 1000 times fewer rows.
    """
    order = F.xxhash64("__id", "__tie", "__dup", F.lit(seed)).alias("__order")
    blocks = F.ceil(F.col("__n") / BLOCK_UNITS).cast("long")
    done, left, level = None, units, 0
    while True:
        keyed = left.select("*", order).withColumns({
            "__block": F.pmod(F.xxhash64("__order", F.lit("block")), blocks), "__land": F.col("__n") <= BLOCK_UNITS})
        flown = stored(keyed.groupBy("__group", "__block").applyInArrow(_fly(seed, level), _UNITS), "flight")
        fixed = flown.filter("p = 0 or p = 1")
        done = fixed if done is None else done.unionByName(fixed)
        left, level = flown.filter("p > 0 and p < 1").withColumn("__n", 2 * blocks), level + 1
        if left.isEmpty():
            return done.drop("__n")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``taken`` = copies x size, copies 0 to 3.  Null text: size 0.  Null source: a source of its own, last in order.
    A null id is a document like any other.  Rows that repeat an id (and text) are separate documents with their own
    draws.  Empty table: no rows.
    """
    counted = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    again = Window.partitionBy("__id", "__tie", "__source").orderBy("size")
    rows = counted.withColumn("__dup", F.row_number().over(again).cast("long"))
    per = source_targets(counted, weights).select("__source", "source_size", "target", F.col("n").alias("__n"),
                         F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"))
    both = rows.join(per, rows["__source"].eqNullSafe(per["__source"])).drop(per["__source"])
    whole = F.least(F.floor("ratio"), F.lit(MAX_COPIES)).cast("long")
    both = both.withColumns({"whole": whole, "p": F.greatest(F.lit(0.0), F.least(F.col("ratio") - whole, F.lit(1.0))),
                             "__group": F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit("n"))})
    both = stored(both, "units")
    open_ = both.filter("p > 0").select("__group", "__id", "__tie", "__dup", "size", "p", "__n")
    drawn = balanced_sample(open_, seed).select(
        F.col("__id").alias("i"), F.col("__tie").alias("t"), F.col("__dup").alias("d"), F.col("p").cast("long").alias("extra"))
    out = both.join(drawn, both["__id"].eqNullSafe(drawn["i"]) & (both["__tie"] == drawn["t"]) & (both["__dup"] == drawn["d"]), "left")
    copies = F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))
    return out.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), "size", "source_size", "target",
                      copies.alias("copies"), (copies * F.col("size")).alias("taken"), "__tie", "__dup")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[float, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    plan = mix(docs, id_col, text_col, source_col, weights, seed).groupBy(
        F.col("doc_id").alias("i"), F.col("__tie").alias("t"), F.col("source").alias("s")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = stored(plan.filter("copies > 0"), "plan")
    marked = packed(docs).select("__row", F.col(f"__row.`{id_col}`").cast("long").alias("__i"), F.xxhash64(text_bytes(f"__row.`{text_col}`")).alias("__t"),
                                 F.col(f"__row.`{source_col}`").cast("string").alias("__s"))
    both = marked.join(plan, marked["__t"].eqNullSafe(plan["t"]) & marked["__i"].eqNullSafe(plan["i"]) & marked["__s"].eqNullSafe(plan["s"]))
    if not plan.filter("rows > 1").isEmpty():  # repeated rows share their copies
        rank = F.row_number().over(Window.partitionBy("i", "t", "s").orderBy("t"))
        share = F.floor(F.col("copies") / F.col("rows")) + (rank <= F.col("copies") % F.col("rows")).cast("long")
        both = both.withColumn("copies", share).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return both.select("__row", times).select("__row.*")
