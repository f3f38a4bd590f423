"""Approximate nearest neighbours by inner product: NN-descent graph and greedy graph search.

Vectors live in hash buckets of bounded size; every step is a join of rows with the bucket that holds what they need.
The graph starts from the cells of a few random hyperplane trees and improves by NN-descent: the neighbours and
reverse neighbours of a node are compared with each other, and what beats a member's worst neighbour is offered to it.
For the search every list takes in nodes that name its own, so far nodes, which few lists hold, can be reached.
Queries walk the graph best-first with a bounded list of open nodes.  Equal vectors are one node.

Inner products are made a metric for the graph by one extra component, sqrt(M^2 - |x|^2), with M the largest norm;
it is 0 in a query, so a query's score is its plain inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwise.llm.common import shuffle_partitions, stored

#: Nodes that a bucket is planned for, and that a tree cell is planned for.
BUCKET_ROWS, CELL_ROWS = 4096, 512
TREES, NEIGHBOURS, FROM_CELL, DESCENTS, OFFERS = 10, 32, 16, 2, 4
#: Reverse neighbours added to a node's list for the search.
REVERSE = 16
LINKS = NEIGHBOURS + REVERSE
#: Members compared with each other at once; a node with more members is cut into groups.
JOIN_ROWS = 256
#: Search: best nodes kept and opened in a round.
WIDTH, OPENED = 160, 64
#: Common start nodes of all queries: so many of largest norm, and so many in hash order.
ENTRIES = 128

_NODE = "b long, id long, vec binary, nbr binary, sc binary"


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _cells(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one flat array of ``dtype`` and the lengths of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.empty(0, dtype), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0]:offsets[-1]]
    return np.ascontiguousarray(flat).view(dtype), np.diff(offsets) // size


def _pack(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of a flat array as a binary column."""
    size = flat.dtype.itemsize
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64) * size
    if offsets[-1] >= 2**31:
        raise ValueError("a batch of more than 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _ints(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64))


# ---------------------------------------------------------------- vectors


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, key)``: id and the float64 components as bytes, of the rows that take part.

    Out are null ids and vectors, null or non-finite components, zero vectors, and vectors of another length than the
    most frequent one.  Rows that repeat an id count once (the least bytes, should the vectors differ).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("v") == (top.d if top else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), _pack(flat, np.diff(lists.offsets.to_numpy()))], names=["id", "key"])

    return rows.mapInArrow(pack, "id long, key binary").groupBy("id").agg(F.min("key").alias("key"))


def _nodes(distinct: DataFrame, buckets: int) -> DataFrame:
    """``(id, key)`` -> ``(b, id, vec)`` with the extra component, in 32-bit floats."""
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _cells(batch.column(0), "<f8")
            yield pa.RecordBatch.from_arrays([pa.array((flat.reshape(len(n), -1) ** 2).sum(axis=1))], names=["n"])

    most = distinct.select("key").mapInArrow(norms, "n double").agg(F.max("n")).first()[0] or 1.0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat, n = _cells(batch.column(1), "<f8")
            x = flat.reshape(len(n), -1)
            extra = np.sqrt(np.maximum(0.0, most - (x**2).sum(axis=1)))
            full = (np.c_[x, extra] / np.sqrt(most)).astype("<f4")
            yield pa.RecordBatch.from_arrays([_ints(bucket_of(ids, buckets)), batch.column(0), _pack(full.ravel(), np.full(len(ids), full.shape[1]))], names=["b", "id", "vec"])

    return distinct.select("id", "key").mapInArrow(build, "b long, id long, vec binary")


# ---------------------------------------------------------------- graph


def _best(owner, other, score, k: int):
    """The k best distinct others of each owner; owners ascending, best first, ties to the smaller id."""
    order = np.lexsort((-score, other, owner))
    owner, other, score = owner[order], other[order], score[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])][:len(owner)]
    owner, other, score = owner[new], other[new], score[new]
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][:len(owner)])
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    keep = rank < k
    return owner[keep], other[keep], score[keep]


def _lists(owner, other, score) -> tuple[np.ndarray, pa.Array, pa.Array]:
    ids, n = np.unique(owner, return_counts=True)
    return ids, _pack(other.astype("<i8"), n), _pack(score.astype("<f4"), n)


def _offers(owner, other, score, buckets: int) -> pa.Table:
    """Offers as one row for each bucket that holds owners: ``(b, owner, nbr, sc)`` of equal length."""
    b = bucket_of(owner, buckets)
    order = np.argsort(b, kind="stable")
    b, n = np.unique(b, return_counts=True)
    return pa.table({"b": _ints(b), "owner": _pack(owner[order].astype("<i8"), n), "nbr": _pack(other[order].astype("<i8"), n),
                     "sc": _pack(score[order].astype("<f4"), n)})


_OFFER = "b long, owner binary, nbr binary, sc binary"


def _tree_codes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TREES, dim, bits)).astype(np.float32)


def _codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    power = 1 << np.arange(planes.shape[1], dtype=np.int64)
    return (x @ planes > 0) @ power


def first_graph(nodes: DataFrame, total: int, buckets: int, dim: int, seed: int) -> DataFrame:
    """Offers from the cells of random hyperplane trees.

    Cells are cut further by a hash of the id when they hold far more rows than planned.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, total) / CELL_ROWS))))
    planes = _tree_codes(dim, bits, seed)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _cells(batch.column(1), "<f4")
            x = flat.reshape(len(n), dim)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([_ints(np.full(len(n), t)), _ints(_codes(x, planes[t])), *batch.columns], names=["tree", "cell", "id", "vec"])

    dealt = nodes.select("id", "vec").mapInArrow(cells, "tree long, cell long, id long, vec binary")
    large = stored(dealt.groupBy("tree", "cell").count().filter(F.col("count") > 4 * CELL_ROWS), "cells")
    salt = F.lit(0).cast("long")
    if not large.isEmpty():
        dealt = dealt.join(large, ["tree", "cell"], "left")
        salt = F.pmod(F.xxhash64("id", "tree"), F.coalesce(F.ceil(F.col("count") / (2 * CELL_ROWS)), F.lit(1)).cast("long"))
    dealt = dealt.withColumn("salt", salt).select("tree", "cell", "salt", "id", "vec")

    def near(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        flat, n = _cells(t["vec"], "<f4")
        x = flat.reshape(len(n), dim)
        k = min(FROM_CELL, len(ids) - 1)
        if k < 1:
            return _offers(ids[:0], ids[:0], np.empty(0, np.float32), buckets)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        j = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return _offers(np.repeat(ids, k), ids[j].ravel(), np.take_along_axis(s, j, 1).ravel(), buckets)

    return dealt.groupBy("tree", "cell", "salt").applyInArrow(near, _OFFER)


def _merge(nodes: DataFrame, offers: DataFrame, keep: int = NEIGHBOURS) -> DataFrame:
    """Nodes with their lists, of ``keep`` entries at most, renewed from offers."""
    def renew(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["id"].to_numpy()
        if not len(ids):
            return left.select(["b", "id", "vec", "nbr", "sc"])
        had, n = _cells(left["nbr"], "<i8")
        old = (np.repeat(ids, n), had, _cells(left["sc"], "<f4")[0])
        new = (_cells(right["owner"], "<i8")[0], _cells(right["nbr"], "<i8")[0], _cells(right["sc"], "<f4")[0])
        owner, other, score = (np.concatenate(x) for x in zip(old, new))
        owner, other, score = _best(owner, other, score, keep)
        got, nbr, sc = _lists(owner, other, score)
        at = np.searchsorted(got, ids)
        hit = (at < len(got)) & (got[np.minimum(at, max(0, len(got) - 1))] == ids) if len(got) else np.zeros(len(ids), bool)
        take = pa.array(np.where(hit, at, 0), mask=~hit)
        lists = [x.take(take).fill_null(b"") for x in (nbr, sc)]
        return pa.table({"b": left["b"], "id": left["id"], "vec": left["vec"], "nbr": lists[0], "sc": lists[1]})

    return nodes.groupBy("b").cogroup(offers.groupBy("b")).applyInArrow(renew, _NODE)


def _members(buckets: int):
    """Every edge both ways: (bucket of u, u, v) for u a member of v's local join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, n = _cells(batch.column(1), "<i8")
            own = np.repeat(batch.column(0).to_numpy(), n)
            u, v = np.r_[other, own], np.r_[own, other]
            yield pa.RecordBatch.from_arrays([_ints(bucket_of(u, buckets)), _ints(u), _ints(v)], names=["b", "u", "v"])

    return run


def descend(nodes: DataFrame, buckets: int, dim: int) -> DataFrame:
    """One NN-descent round: join members with their vectors, compare neighbours of neighbours, merge the offers."""
    members = nodes.select("id", "nbr").mapInArrow(_members(buckets), "b long, u long, v long")

    def with_vectors(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v = left["u"].to_numpy(), left["v"].to_numpy()
        ids = right["id"].to_numpy()
        flat, n = _cells(right["vec"], "<f4")
        x = flat.reshape(len(n), dim).astype("<f2")
        score, m = _cells(right["sc"], "<f4")
        worst = np.full(len(ids), -np.inf, np.float64)
        full = m >= NEIGHBOURS
        worst[full] = score[np.cumsum(m)[full] - 1]
        order = np.argsort(ids)
        pair = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.empty((0, 2), np.int64)
        at = order[np.searchsorted(ids[order], pair[:, 0])] if len(pair) else np.empty(0, np.int64)
        return pa.table({"g": _ints(bucket_of(pair[:, 1], buckets)), "v": _ints(pair[:, 1]), "u": _ints(pair[:, 0]),
                         "worst": pa.array(worst[at]), "vec": _pack(x[at].ravel(), np.full(len(at), dim))})

    joined = members.groupBy("b").cogroup(nodes.groupBy("b")).applyInArrow(with_vectors, "g long, v long, u long, worst double, vec binary")

    def local_join(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        u, v, worst = t["u"].to_numpy(), t["v"].to_numpy(), t["worst"].to_numpy()
        flat, n = _cells(t["vec"], "<f2")
        x = flat.reshape(len(n), dim)
        order = np.lexsort((bucket_of(u, 1 << 30), v))
        u, v, worst, x = u[order], v[order], worst[order], x[order].astype(np.float32)
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        own, other, score = [], [], []
        for a, z in zip(starts, np.r_[starts[1:], len(v)]):
            for lo in range(a, z, JOIN_ROWS):
                hi = min(z, lo + JOIN_ROWS)
                k = min(OFFERS, hi - lo - 1)
                if k < 1:
                    continue
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -np.inf)
                j = np.argpartition(-s, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(s, j, 1)
                r, c = np.nonzero(top > worst[lo:hi, None])
                own.append(u[lo + r])
                other.append(u[lo + j[r, c]])
                score.append(top[r, c])
        owner, other, score = (np.concatenate(y) if y else np.empty(0, d) for y, d in ((own, np.int64), (other, np.int64), (score, np.float32)))
        return _offers(*_best(owner, other, score, NEIGHBOURS), buckets)

    offers = joined.groupBy("g").applyInArrow(local_join, _OFFER)
    return _merge(nodes, offers)


def two_way(nodes: DataFrame, buckets: int) -> DataFrame:
    """Lists with up to REVERSE more entries: nodes that name this one.  Far nodes are in few lists, so the search would not
    reach them by forward edges alone."""
    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, n = _cells(batch.column(1), "<i8")
            by = np.repeat(batch.column(0).to_numpy(), n)
            rows = _offers(*_best(named, by, _cells(batch.column(2), "<f4")[0], LINKS), buckets)
            yield from rows.to_batches() if isinstance(rows, pa.Table) else [rows]

    return _merge(nodes, nodes.select("id", "nbr", "sc").mapInArrow(turned, _OFFER), LINKS)


def build_graph(distinct: DataFrame, seed: int = 7) -> tuple[DataFrame, int, int]:
    """``(id, key)`` of distinct vectors -> stored nodes ``(b, id, vec, nbr, sc)``, number of buckets, dimension."""
    total = distinct.count()
    first = distinct.select((F.octet_length("key") / 8).cast("int").alias("d")).first()
    dim = first.d + 1 if first else 1
    buckets = max(1, -(-total // BUCKET_ROWS))
    bare = stored(_nodes(distinct, buckets), "vectors")
    empty = F.lit(b"")
    nodes = stored(_merge(bare.withColumns({"nbr": empty, "sc": empty}), first_graph(bare, total, buckets, dim, seed)), "graph")
    for _ in range(DESCENTS):
        nodes = stored(descend(nodes, buckets, dim), "graph")
    return stored(two_way(nodes, buckets), "graph"), buckets, dim


# ---------------------------------------------------------------- search

_STATE = "g long, q long, vec binary, ids binary, sc binary, opened binary, pick binary"
_ASK = "b long, g long, q long, vec binary, least double, cands binary"


def _by_bucket(values: np.ndarray, sizes: np.ndarray, buckets: int):
    """Rows of ids cut by the bucket of each id: bucket and row of every piece, and the pieces as a binary column."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    b = bucket_of(values, buckets)
    order = np.lexsort((b, row))
    values, row, b = values[order], row[order], b[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (b[1:] != b[:-1])][:len(row)])
    return b[starts], row[starts], _pack(values.astype("<i8"), np.diff(np.r_[starts, len(row)]))


def _asks(t: pa.Table | pa.RecordBatch, cands: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.Table:
    """A row for each query of ``t`` and each bucket that holds some of its candidates."""
    b, row, pieces = _by_bucket(cands, sizes, buckets)
    score, m = _cells(t.column("sc"), "<f4")
    least = np.full(len(m), -np.inf)
    full = m >= WIDTH
    least[full] = score[np.cumsum(m)[full] - 1]
    at = pa.array(row)
    return pa.table({"b": _ints(b), "g": t.column("g").take(at), "q": t.column("q").take(at), "vec": t.column("vec").take(at),
                     "least": pa.array(least[row]), "cands": pieces})


def _first_asks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _asks(batch, *_cells(batch.column(batch.schema.get_field_index("cands")), "<i8"), buckets).to_batches()

    return run


def _list_asks(buckets: int):
    """A row for each query and bucket that holds some of the nodes it opens; the query's vector stays behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, row, pieces = _by_bucket(*_cells(batch.column(2), "<i8"), buckets)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([_ints(b), batch.column(0).take(at), batch.column(1).take(at), pieces], names=["b", "g", "q", "pick"])

    return run


def _opened_lists(left: pa.Table, right: pa.Table) -> pa.Table:
    """The distinct neighbours of the nodes that a query opens in this bucket."""
    ids = right["id"].to_numpy()
    order = np.argsort(ids)
    nbr, m = _cells(right["nbr"], "<i8")
    begin = (np.cumsum(m) - m)[order]
    m, ids = m[order], ids[order]
    pick, sizes = _cells(left["pick"], "<i8")
    at = np.searchsorted(ids, pick)
    ends = np.cumsum(sizes)
    out = [np.unique(np.concatenate([nbr[begin[j]:begin[j] + m[j]] for j in at[a:z]])) for a, z in zip(ends - sizes, ends)]
    return pa.table({"g": left["g"], "q": left["q"], "cands": _pack(np.concatenate(out) if out else nbr[:0], np.array([len(x) for x in out], np.int64))})


def _next_asks(buckets: int):
    """The neighbours of opened nodes that are not on the query's list yet, as asks to the buckets that hold them."""
    def run(state: pa.Table, lists: pa.Table) -> pa.Table:
        news: dict[int, list[np.ndarray]] = {}
        for q, c in zip(lists["q"].to_pylist(), lists["cands"].to_pylist()):
            news.setdefault(q, []).append(np.frombuffer(c, "<i8"))
        cands = [np.setdiff1d(np.concatenate(news[q]), np.frombuffer(i, "<i8")) if q in news else np.empty(0, np.int64)
                 for q, i in zip(state["q"].to_pylist(), state["ids"].to_pylist())]
        return _asks(state, np.concatenate([np.empty(0, np.int64), *cands]), np.array([len(c) for c in cands], np.int64), buckets)

    return run


def _answers(dim: int):
    """Score candidates at the bucket that holds them; only those that can enter the query's list go back."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        flat, n = _cells(right["vec"], "<f4")
        x = flat.reshape(len(n), dim)[order]
        cands, sizes = _cells(left["cands"], "<i8")
        ends = np.cumsum(sizes)
        vecs, _ = _cells(left["vec"], "<f4")
        vecs = vecs.reshape(len(sizes), dim)
        least = left["least"].to_numpy()
        at = np.searchsorted(ids, cands)
        got_id, got_sc, got_n = [], [], []
        for i, (a, z) in enumerate(zip(ends - sizes, ends)):
            s = x[at[a:z]] @ vecs[i]
            keep = np.flatnonzero(s > least[i])
            if len(keep) > WIDTH:  # the best WIDTH of this bucket hold all that can be among the best WIDTH of all
                keep = keep[np.lexsort((cands[a:z][keep], -s[keep]))[:WIDTH]]
            got_id.append(cands[a:z][keep])
            got_sc.append(s[keep])
            got_n.append(len(keep))
        lengths = np.array(got_n, np.int64)
        cat = lambda y, d: np.concatenate(y).astype(d) if y else np.empty(0, d)
        return pa.table({"g": left["g"], "q": left["q"], "ids": _pack(cat(got_id, "<i8"), lengths), "sc": _pack(cat(got_sc, "<f4"), lengths)})

    return run


def _advance(state: pa.Table, answers: pa.Table) -> pa.Table:
    """Merge the answers into each query's list and pick its best nodes not opened yet."""
    news: dict[int, list[tuple]] = {}
    for q, i, s in zip(answers["q"].to_pylist(), *(answers[c].to_pylist() for c in ("ids", "sc"))):
        news.setdefault(q, []).append((np.frombuffer(i, "<i8"), np.frombuffer(s, "<f4")))
    out = {k: [] for k in ("ids", "sc", "opened", "pick")}
    for q, i, s, o in zip(state["q"].to_pylist(), *(state[c].to_pylist() for c in ("ids", "sc", "opened"))):
        parts = [(np.frombuffer(i, "<i8"), np.frombuffer(s, "<f4"), np.frombuffer(o, np.uint8))]
        parts += [(a, b, np.zeros(len(a), np.uint8)) for a, b in news.get(q, ())]
        ids, sc, opened = (np.concatenate([p[j] for p in parts]) for j in range(3))
        order = np.lexsort((1 - opened, ids))  # an opened entry wins over the same node found anew
        first = np.r_[True, ids[order][1:] != ids[order][:-1]][:len(ids)]
        order = order[first]
        order = order[np.lexsort((ids[order], -sc[order]))][:WIDTH]
        ids, sc, opened = ids[order], sc[order], opened[order].copy()
        pick = np.flatnonzero(opened == 0)[:OPENED]
        opened[pick] = 1
        for key, value in (("ids", ids.astype("<i8")), ("sc", sc.astype("<f4")), ("opened", opened), ("pick", ids[pick].astype("<i8"))):
            out[key].append(value.tobytes())
    return pa.table({"g": state["g"], "q": state["q"], "vec": state["vec"], **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def entry_points(nodes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, vectors and lists of 2 x ENTRIES nodes at most.  Large vectors win inner products, whatever lies near the
    query's own node.  They travel with the job, so the buckets that hold them are not asked by every query."""
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _cells(batch.column(1), "<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat.reshape(len(n), dim)[:, -1].astype(np.float64))], names=["id", "extra"])

    rows = nodes.select("id", "vec").mapInArrow(norms, "id long, extra double")
    large = rows.orderBy("extra", F.xxhash64("id")).limit(ENTRIES).collect()
    spread = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(ENTRIES).collect()
    chosen = sorted({r.id for r in [*large, *spread]})
    held = nodes.filter(F.col("id").isin(chosen)).select("id", "vec", "nbr").orderBy("id").collect()
    vecs = np.array([np.frombuffer(bytes(r.vec), "<f4") for r in held], np.float32).reshape(-1, dim)
    return np.array([r.id for r in held], np.int64), vecs, [np.frombuffer(bytes(r.nbr), "<i8") for r in held]


def search(nodes: DataFrame, buckets: int, dim: int, queries: DataFrame) -> DataFrame:
    """``queries(q, vec, ids, sc, opened, cands)``: id, 32-bit vector with a zero extra component, nodes scored so far
    (best first, those opened marked 1) and packed start candidates -> ``(g, q, vec, ids, sc)`` with the best WIDTH nodes
    found of each query, best first.

    A round has two joins: the buckets of opened nodes send their neighbours, the buckets of the neighbours send scores.
    So lists never travel with nodes that are not opened.  It ends when no query has an open node left: each is opened
    once a query at most, and only while it is among its best."""
    spark = nodes.sparkSession
    groups = F.pmod(F.xxhash64("q"), F.lit(4 * shuffle_partitions(spark))).alias("g")
    first = stored(queries.select(groups, "q", "vec", "ids", "sc", "opened", "cands"), "search")
    state = first.drop("cands").withColumn("pick", F.lit(b""))
    asks = first.select("g", "q", "vec", "sc", "cands").mapInArrow(_first_asks(buckets), _ASK)
    vectors, lists = nodes.select("b", "id", "vec"), nodes.select("b", "id", "nbr")
    while True:
        answers = asks.groupBy("b").cogroup(vectors.groupBy("b")).applyInArrow(_answers(dim), "g long, q long, ids binary, sc binary")
        state = stored(state.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_advance, _STATE), "search")
        open_ = state.filter(F.octet_length("pick") > 0)
        if open_.isEmpty():
            return state.select("g", "q", "vec", "ids", "sc")
        found = open_.select("g", "q", "pick").mapInArrow(_list_asks(buckets), "b long, g long, q long, pick binary").groupBy("b").cogroup(
            lists.groupBy("b")).applyInArrow(_opened_lists, "g long, q long, cands binary")
        asks = open_.select("g", "q", "vec", "ids", "sc").groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_next_asks(buckets), _ASK)


def nearest(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product that the graph search finds for each row whose id is divisible by ``every``.

    ``query_id, rank`` (from 1), ``vec_id, score``: exact double inner products of the original vectors, nearest
    first, ties to the smaller id, the query itself left out.  Fewer candidates than k: all that are found.  Rows that
    ``valid_vectors`` leaves out take no part; without any vector the result is empty.
    """
    rows = stored(valid_vectors(df, id_col, vec_col), "valid")
    distinct = stored(rows.groupBy("key").agg(F.min("id").alias("id")), "distinct")
    nodes, buckets, dim = build_graph(distinct)
    asked = rows.filter(F.col("id") % every == 0).join(distinct.withColumnRenamed("id", "rep"), "key").select("id", "rep")
    asked = stored(asked, "asked")

    entry_ids, entry_vecs, entry_lists = entry_points(nodes, dim)

    def starts(left: pa.Table, right: pa.Table) -> pa.Table:
        """A query starts from its own node and the best entry points, all opened."""
        ids = right["id"].to_numpy()
        own = right.take(pa.array(np.flatnonzero(np.isin(ids, left["rep"].to_numpy()))))
        vec, n = _cells(own["vec"], "<f4")
        x = vec.reshape(len(n), dim).copy()
        x[:, -1] = 0
        out = {c: [] for c in ("ids", "sc", "opened", "cands")}
        for i, b, v in zip(own["id"].to_pylist(), own["nbr"].to_pylist(), x):
            s = entry_vecs @ v
            best = np.lexsort((entry_ids, -s))[:WIDTH - 1]
            best = best[entry_ids[best] != i]
            held, score = np.r_[i, entry_ids[best]], np.r_[v @ v, s[best]]
            opened = (np.arange(len(held)) < OPENED).astype(np.uint8)
            cands = np.setdiff1d(np.concatenate([np.frombuffer(b, "<i8"), *(entry_lists[j] for j in best[:OPENED - 1])]), held)
            order = np.lexsort((held, -score))
            for c, value in (("ids", held[order].astype("<i8")), ("sc", score[order].astype("<f4")), ("opened", opened[order]), ("cands", cands.astype("<i8"))):
                out[c].append(value.tobytes())
        return pa.table({"q": own["id"], "vec": _pack(x.ravel(), np.full(len(n), dim)), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_ints(bucket_of(batch.column(0).to_numpy(), buckets)), batch.column(0)], names=["b", "rep"])

    reps = asked.select("rep").distinct().mapInArrow(put, "b long, rep long")
    queries = reps.groupBy("b").cogroup(nodes.groupBy("b")).applyInArrow(
        starts, "q long, vec binary, ids binary, sc binary, opened binary, cands binary")
    found = search(nodes, buckets, dim, queries)

    # exact scores: the vectors of a query and of what it found meet by joins on their nodes
    near = 2 * k

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = _cells(batch.column(1), "<i8")
            q = np.repeat(batch.column(0).to_numpy(), n)
            rank = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([_ints(q[rank <= near]), _ints(ids[rank <= near])], names=["q", "c"])

    cand = found.select("q", "ids").mapInArrow(pairs, "q long, c long").unionByName(found.select("q", F.col("q").alias("c"))).distinct()
    keys = distinct.select("id", "key")
    cand = cand.join(keys.select(F.col("id").alias("c"), F.col("key").alias("ck")), "c").join(
        keys.select(F.col("id").alias("q"), F.col("key").alias("qk")), "q")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n = _cells(batch.column(2), "<f8")
            b, _ = _cells(batch.column(3), "<f8")
            score = (a.reshape(len(n), -1) * b.reshape(len(n), -1)).sum(axis=1) if len(n) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["q", "c", "score"])

    scored = cand.select("q", "c", "ck", "qk").mapInArrow(exact, "q long, c long, score double")
    # rows of equal vectors: at most k + 1 of them, those of least id, can reach a result
    copies = rows.join(distinct.withColumnRenamed("id", "c"), "key").select("c", F.col("id").alias("vec_id"))
    copies = copies.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = scored.join(copies, "c").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("q", "vec_id", "score")
    final = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("q")).join(lists, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, spark: SparkSession, df: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           every: int = 20) -> float:
    """Share of the true k nearest that ``found`` holds, against brute force over all queries, lost ones too (for tests)."""
    rows = valid_vectors(df, id_col, vec_col).collect()
    ids = np.array([r.id for r in rows])
    x = np.stack([np.frombuffer(bytes(r.key), "<f8") for r in rows])
    got: dict[int, set[int]] = {int(i): set() for i in ids if i % every == 0}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = all_ = 0
    at = {i: n for n, i in enumerate(ids)}
    for q in got:
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        true = ids[np.lexsort((ids, -s))[:min(k, len(ids) - 1)]]
        hit += len(got[q] & set(true.tolist()))
        all_ += len(true)
    return hit / max(1, all_)
