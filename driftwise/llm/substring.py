"""Substring near-dedup with compact windows: passages of 50 words or more that recur in other texts.

Under one hash function the subsequences of a text that share their minimum form a compact window; the windows are the
nodes of the Cartesian tree over the shingle hashes.  Two passages of 50 words that are similar (Jaccard of 5-word shingles
0.8) differ by one word at most, so they have a run of 25 words, 21 shingles, in common.  For each function the compact windows
of 21 shingles or more divide all such runs of a text among their minima; an interval join of the divisions of all
functions gives cells, runs that share the minima of every function.  Equal runs fall into equal cells, so a
shuffle on (minima, distance) brings all texts together that may be alike, whatever their number.

Texts of a cell are verified by the words themselves, in two steps and without comparing pairs.  Texts that hold the same
50 words at the same place of a cell are linked first.  What is left are cells in which several classes meet.  Their
runs are compared as 25 words; for runs that several classes have, all sequences of 49 words that begin or end with the run and skip one
word are hashed (``sequences``): texts that differ by one word replaced, inserted or dropped have one in common.  Links join texts into classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwise.llm.common import HOT_SHARE, lookup, shuffle_partitions, stored, text_bytes
from driftwise.llm.components import components

SHINGLE, PASSAGE, SIMILARITY = 5, 50, 0.8
#: Shingles of a shortest passage, and that two similar ones without repeats have in common at least.
LEAST = PASSAGE - SHINGLE + 1
COMMON = int(np.ceil(2 * LEAST * SIMILARITY / (1 + SIMILARITY)))
#: Words of the longer side of an edit, and the shingles in them: the shortest run that similar passages share.
SIDE = PASSAGE // 2
RUN = SIDE - SHINGLE + 1
#: Hash functions whose minima a cell shares.
FUNCTIONS = 2
#: Shortest run of equal words that makes passages similar by itself: it holds COMMON shingles.
EXACT = COMMON + SHINGLE - 1
#: Words of a long text handled at once; pieces overlap by two passages.
PIECE = 1 << 15
#: Shares of the texts and of stored rows that are read to find very common keys, and the least rows of such a key among them.
PROBE, PROBE_STORED, PROBE_ROWS = 1 / 64, 1 / 16, 100
#: Bytes of requests for text, and of classes of texts, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, b in enumerate((_BASE, inverse)):
            run = np.full(size, b)
            run[0] = 1
            _POWERS[i] = np.cumprod(run)
    return _POWERS[0], _POWERS[1]


_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of runs of words of a text, A-Z in lower case, by prefix sums of a polynomial over its bytes."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b" ".join(words), np.uint8)
        gaps = np.flatnonzero(data == 32)
        self.n = len(words)
        self.first, self.end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)])]

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on."""
        if self.n < k:
            return np.empty(0, np.uint64)
        a, z = self.first[:self.n - k + 1], self.end[k - 1:]
        return _mix((self.sums[z] - self.sums[a]) * self.inverse[a])

    def runs_at(self, place: np.ndarray, k: int) -> np.ndarray:
        """``runs(k)[place]``, of these places alone."""
        a, z = self.first[place], self.end[place + k - 1]
        return _mix((self.sums[z] - self.sums[a]) * self.inverse[a])


def compact_windows(h: np.ndarray, least: int) -> np.ndarray:
    """Positions of the minima of all compact windows of at least ``least`` elements."""
    return bounded_windows(h, least)[:, 0]


def bounded_windows(h: np.ndarray, least: int) -> np.ndarray:
    """``minimum, start, end`` of all compact windows of at least ``least`` elements (Cartesian tree, top down)."""
    out, stack = [], [(0, len(h))] if len(h) >= least else []
    while stack:
        a, z = stack.pop()
        c = a + int(h[a:z].argmin())
        out.append((c, a, z))
        if c - a >= least:
            stack.append((a, c))
        if z - c > least:
            stack.append((c + 1, z))
    return np.array(out, np.int64).reshape(-1, 3)


def starts_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, minimum)``: from run ``first`` on (up to the next one) runs of RUN shingles have this minimum.

    A compact window (minimum c, start a, end z) has the runs from max(a, c - RUN + 1) to min(c, z - RUN); every run has
    one minimum, so the windows of a function divide the runs of a text.
    """
    c, a = windows[:, 0], windows[:, 1]
    first = np.maximum(a, c - RUN + 1)
    order = np.argsort(first)
    return first[order], c[order]


def cells_of(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """``key, at, first, end`` of the cells of a text with shingle hashes ``h``: interval join of the runs of all functions.

    ``at`` is the minimum of the first function, [first, end) the runs of the cell.
    """
    hashes = _mix(h ^ _SEEDS[:FUNCTIONS, None])
    parts = [starts_of(bounded_windows(x, RUN)) for x in hashes]
    first = np.unique(np.concatenate([p[0] for p in parts]))
    minima = [c[np.searchsorted(begin, first, "right") - 1] for begin, c in parts]
    key = hashes[0][minima[0]]
    for x, c in zip(hashes[1:], minima[1:]):
        key = _mix(key * _BASE + x[c] + (c - minima[0]).astype(np.uint64))
    return key, minima[0], first, np.r_[first[1:], len(h) - RUN + 1]


def pieces_of(text: bytes) -> Iterator[tuple[int, Words]]:
    """``(first word, words)`` of a text of PASSAGE words or more, in pieces that overlap by two passages."""
    words = text.lower().split()
    for start in range(0, max(1, len(words) - 2 * PASSAGE), PIECE):
        piece = words[start:start + PIECE + 2 * PASSAGE]
        if len(piece) >= PASSAGE:
            yield start, Words(piece)


def _longs(names: list[str], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=names)


def _gathered(names: list[str], parts: Iterator[tuple[np.ndarray, ...]], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for part in parts:
        rows.append(part)
        size += len(part[0])
        if size > most:
            yield _longs(names, (np.concatenate([r[i] for r in rows]) for i in range(len(names))))
            rows, size = [], 0
    if size:
        yield _longs(names, (np.concatenate([r[i] for r in rows]) for i in range(len(names))))


#: ``wide``: 56 bits of a hash of all words that the runs of a cell reach, over 8 bits of the number of runs; 0 near an end of a text.
_CELL = ["key", "node", "first", "wide", "same"]
_CELLS = ", ".join(f"{c} long" for c in _CELL)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of texts; ``same`` is the hash of the 50 words around the minimum (of those nearest to it at an end of the text)."""
    done: set[int] = set()

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node in done:  # a copy in the same task; copies in other tasks make equal rows
                    continue
                if len(done) >= 500_000:
                    done.clear()
                done.add(node)
                for start, own in pieces_of(text.as_py()):
                    key, at, first, end = cells_of(own.runs(SHINGLE))
                    same = own.runs_at(np.clip(at - (PASSAGE - SHINGLE) // 2, 0, own.n - PASSAGE), PASSAGE)
                    # a run of the cell starts RUN - 1 shingles before its minimum at most and is looked at with SIDE words on both sides
                    back, reach = SIDE + RUN - 1, SIDE + RUN - 1 + PASSAGE
                    inside = (at >= back) & (at - back + reach <= own.n)
                    wide = np.zeros(len(at), np.uint64)
                    wide[inside] = (_mix(own.runs_at(at[inside] - back, reach)) << np.uint64(8)) >> np.uint64(1)  # no sign
                    wide = (wide >> np.uint64(8) << np.uint64(8)) | (end - first).astype(np.uint64)
                    yield key, np.full(len(key), node), first + start, wide, same

    return _gathered(_CELL, parts())


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node: those whose key more than one text has, or that are dealt by text (``hot``), without repeats.

    The last key of a batch waits for the next one; once a second text is seen, its rows go out as they come.
    """
    held, open_ = None, None  # columns of the key that is not known yet; key known to be shared
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.r_[x, y] for x, y in zip(held, cols)]
        if not len(cols[0]):
            continue
        key, node = cols[:2]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.minimum.reduceat(node, starts) != np.maximum.reduceat(node, starts)
        many |= cols[-1][starts] | (key[starts] == open_ if open_ is not None else False)
        fresh = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
        keep = np.repeat(many, np.diff(np.r_[starts, len(key)])) & fresh
        open_, held = (key[-1], None) if many[-1] else (None, [c[starts[-1]:][fresh[starts[-1]:]] for c in cols])
        if keep.any():
            yield _longs(_CELL, [c[keep] for c in cols[:-1]])


def hot_keys(probe: DataFrame, key: str) -> DataFrame:
    """``key, hot`` of keys with a HOT_SHARE of the rows of a probe: at most 1 / HOT_SHARE of them, so they can be broadcast."""
    counts = stored(probe.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "probe")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") >= max(PROBE_ROWS, total * HOT_SHARE)).select(key, F.lit(True).alias("hot"))


def _ranges(starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the ranges, ascending, and nothing beside them."""
    marks = np.unique(np.concatenate([np.arange(a, z) for a, z in zip(starts, ends)]))
    return marks, np.zeros(len(marks), np.int64)


def _marked(firsts: list[int], marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, ascending, and the marks beside them."""
    order = np.argsort(firsts)
    return np.array(firsts)[order], np.array(marks)[order]


def _asked(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, Words]]:
    """``(node, root, first word, runs in the piece, marks, words)`` of the pieces of texts in which runs are asked for."""
    for batch in batches:
        for node, root, text, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            wanted, marks = read(starts, ends)
            for start, own in pieces_of(text.as_py()):
                here = (wanted >= start) & (wanted + SIDE <= start + own.n)
                if here.any():
                    yield node, root, start, wanted[here] - start, marks[here], own


_HALVES = ["r1", "r2", "r3", "l1", "l2", "l3"]
_RUN = ["run", "node", "root", "first", *_HALVES]


def halves(own: Words, at: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """Of the words beside a run: if texts have an equal one of ``sequences`` that begins (ends) with it, one of the first (last) three is equal.

    The 24 words beyond the run that are equal are first equal up to the edit: an edit in the second half leaves the
    nearer 12 words, one in the first half the farther 11, one word farther where a word is skipped.  Beyond a text: 0.
    """
    half, rest = (SIDE - 1) // 2, SIDE - 2 - (SIDE - 1) // 2
    out = []
    for k, (first, length) in enumerate((
            (SIDE, half), (SIDE + half + 1, rest), (SIDE + half + 2, rest),
            (-half, half), (-half - 1 - rest, rest), (-half - 2 - rest, rest))):
        place = at + first
        inside = (place >= 0) & (place + length <= own.n)
        x = np.zeros(len(at), np.uint64)
        x[inside] = _mix(run[inside] * _BASE + own.runs_at(place[inside], length) + np.uint64(min(k % 3, 1) + 2 * (k // 3)))
        out.append(x)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the SIDE words from each asked run on, with its ``halves``."""
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for node, root, start, here, _, own in _asked(batches, _ranges):
            run = own.runs_at(here, SIDE)
            yield run, np.full(len(here), node), np.full(len(here), root), here + start, *halves(own, here, run)

    return _gathered(_RUN, parts())


def repeats(h: np.ndarray) -> np.ndarray:
    """For each passage of a text: its shingles that stand earlier in it."""
    order = np.argsort(h, kind="stable")
    before = np.full(len(h), -len(h) - PASSAGE)
    again = h[order[1:]] == h[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    near = np.r_[0, np.cumsum(np.arange(len(h)) - before < LEAST)]
    return near[LEAST:] - near[:-LEAST]


def sequences(own: Words, at: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``key, plain`` for runs of SIDE words at ``at``: texts are alike if they have a key in common, plain in one of them.

    Plain keys are PASSAGE equal words; EXACT equal words (they hold COMMON shingles, 5 or fewer stand beside them on each
    side); PASSAGE words that begin or end with the run, but for the word at one place; and PASSAGE - 1 words of that kind
    that are all there.  The last ones meet the keys that are not plain: PASSAGE words without the one at a place.  So two texts differ
    by one word, and COMMON shingles or more are equal.  Where shingles repeat, a passage counts by its equal
    words alone only if two or more of its shingles stand in it before; so every link has the Jaccard similarity.

    ``marks`` are the bits of the ``halves`` that other texts have, by which only some places come into question.
    """
    marks = np.full(len(at), 63) if marks is None else marks
    words = own.runs(1)
    power, inverse = _powers(len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * power[:len(words)])]
    plain = np.r_[repeats(own.runs(SHINGLE)) <= 1, np.zeros(1, bool)]  # by the first word of a passage
    half, last = (SIDE - 1) // 2, own.n - PASSAGE
    out: list[tuple[np.ndarray, bool]] = []

    def full(first: np.ndarray, length: int, kind: int) -> None:
        out.append((_mix((sums[first + length] - sums[first]) * inverse[first] + np.uint64(kind)), True))

    def skipping(first: np.ndarray, place: np.ndarray) -> None:
        """PASSAGE words from ``first`` on without the one at ``place`` of them."""
        first = first[(first >= 0) & (first <= last)]
        first = first[plain[first], None]
        gap = first + place
        key = (sums[gap] - sums[first]) * inverse[first] + (sums[first + PASSAGE] - sums[gap + 1]) * inverse[first + 1]
        out.append((_mix(key + np.uint64(3)).ravel(), False))
        out.append((_mix(_mix(key) + place.astype(np.uint64) + np.uint64(4)).ravel(), True))

    def has(*bits: int) -> np.ndarray:
        return at[(marks & sum(1 << b for b in bits)) != 0]

    near = has(0)
    full(near[near <= last], PASSAGE, 1)
    near = near[near + EXACT <= own.n]
    full(near[plain[np.minimum(near, last)]], EXACT, 2)
    skipping(has(0), SIDE + np.arange(half, SIDE))
    skipping(has(2), SIDE + np.arange(half))
    skipping(has(3) + SIDE - PASSAGE, np.arange(SIDE - half))
    skipping(has(5) + SIDE - PASSAGE, np.arange(SIDE - half, SIDE))
    whole = np.r_[has(0, 1), has(3, 4) + SIDE - PASSAGE + 1]
    whole = whole[(whole >= 0) & (whole + PASSAGE - 1 <= own.n)]
    full(whole[plain[np.minimum(whole, last)]], PASSAGE - 1, 3)
    return np.concatenate([k for k, _ in out]), np.concatenate([np.full(len(k), p) for k, p in out])


def _once(parts: Iterator[tuple[np.ndarray, ...]], most: int = 1_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows ordered by their first column, some at a time, without those that repeat the one before."""
    rows, size = [], 0

    def ordered() -> tuple[np.ndarray, ...]:
        cols = [np.concatenate(c) for c in zip(*rows)]
        order = np.argsort(cols[0])
        cols = [c[order] for c in cols]
        fresh = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
        return tuple(c[fresh] for c in cols)

    for part in parts:
        rows.append(part)
        size += len(part[0])
        if size > most:
            yield ordered()
            rows, size = [], 0
    if size:
        yield ordered()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the ``sequences`` of asked runs; texts of a class have many in common."""
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for _, root, _, here, marks, own in _asked(batches, _marked):
            for i in range(0, len(here), 1024):
                key, plain = sequences(own, here[i:i + 1024], marks[i:i + 1024])
                yield key, np.full(len(key), root), plain

    return _gathered(["seq", "root", "plain"], _once(parts()))


def node_of(text_col: str) -> Column:
    """Texts are told apart by a 64-bit hash of their bytes."""
    return F.xxhash64(text_bytes(text_col))


def meeting(rows: DataFrame, key: str, who: str, named: Column | None = None) -> DataFrame:
    """The (stored) rows whose key several ``who`` have, with ``least``: the least of them (of those that ``named`` holds for, if any).

    Rows are shuffled once, by key, and no table of keys is joined to them.  Very common keys are not dealt: what is known of
    them is broadcast.
    """
    facts = {"__a": F.min(who), "__z": F.max(who)} | ({} if named is None else {"least": F.min(F.when(named, F.col(who)))})
    hot = hot_keys(rows.sample(PROBE_STORED, seed=7), key)
    marked = rows.join(F.broadcast(hot), key, "left")
    common = marked.filter("hot").drop("hot")
    common = common.join(F.broadcast(common.groupBy(key).agg(*[f.alias(n) for n, f in facts.items()])), key)
    by_key = Window.partitionBy(key)
    rest = marked.filter("hot is null").drop("hot").select("*", *[f.over(by_key).alias(n) for n, f in facts.items()])
    met = rest.unionByName(common).filter("__a < __z")
    met = met.withColumnRenamed("__a", "least") if named is None else met.filter("least is not null").drop("__a")
    return met.drop("__z")


def _with_texts(docs: DataFrame, asks: DataFrame, text_col: str) -> DataFrame:
    """``node, root, text, starts, ends`` for the asked ranges ``(node, root, first, end)``; a text's ranges are at most its words."""
    asks = stored(asks.groupBy("node", "root").agg(F.collect_list("first").alias("starts"), F.collect_list("end").alias("ends")), "asks")
    size = asks.agg(F.sum(F.size("starts") * 16 + 48)).first()[0] or 0
    texts = docs.select(node_of(text_col).alias("node"), text_bytes(text_col).alias("text"))
    if size <= BROADCAST_BYTES:
        return texts.join(F.broadcast(asks), "node").select("node", "root", "text", "starts", "ends")
    # one copy of a text: the copies of a very common one are as many rows of one key
    once = texts.join(asks.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return once.join(asks, "node").select("node", "root", "text", "starts", "ends")


def shared_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored cells that more than one text has; those of very common cells are dealt by text, so no task gets them all."""
    texts = docs.select(node_of(text_col).alias("node"), text_bytes(text_col).alias("text"))
    dealt = texts.mapInArrow(_cells, _CELLS).join(F.broadcast(hot_keys(texts.sample(PROBE, seed=7).mapInArrow(_cells, _CELLS), "key")), "key", "left").select(*_CELL, F.coalesce("hot", F.lit(False)).alias("hot"))
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "key", F.when(F.col("hot"), F.col("node")))
    return stored(dealt.sortWithinPartitions("key", "node", "first", "wide").mapInArrow(_shared, _CELLS), "shared")


def passage_links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored ``(a, b)``: distinct pairs of texts (hashes) found to share a passage; they span all classes."""
    shared = shared_cells(docs, text_col)
    same = meeting(shared.select("node", "same"), "same", "node")
    sure = stored(same.filter("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "links")
    # cells in which classes meet
    roots = stored(components(sure).withColumnRenamed("v", "node"), "roots")
    cells = shared.drop("same")
    if roots.count() * 16 <= BROADCAST_BYTES:
        rooted = cells.join(F.broadcast(roots), "node", "left")
    else:
        size = cells.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(roots, "node", "left")
        rooted = lookup(cells, stored(size, "sizes"), ["node"], "n", cells.count()).drop("n")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    open_ = meeting(rooted, "key", "root")
    # of equal cells of a class in equal surroundings one stands for all
    lone = F.when(F.col("wide") < 256, F.struct("node", "first"))
    open_ = open_.groupBy("key", "root", "wide", lone).agg(F.min(F.struct("node", "first")).alias("one"))
    runs_in = F.col("wide").bitwiseAND(F.lit(255))
    open_ = open_.select("one.node", "root", "one.first", (F.col("one.first") + runs_in).alias("end"))
    runs = stored(_with_texts(docs, open_, text_col).mapInArrow(_runs, ", ".join(f"{c} long" for c in _RUN)), "runs")
    met = meeting(runs, "run", "root")
    half = stored(met.select("node", "root", "first", F.posexplode(F.array(*_HALVES)).alias("bit", "half")).filter("half <> 0"), "halves")
    asked = meeting(half, "half", "root").groupBy("node", "root", "first").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("end"))
    found = stored(_with_texts(docs, asked, text_col).mapInArrow(_sequences, "seq long, root long, plain long"), "sequences")
    near = meeting(found, "seq", "root", F.col("plain") == 1).filter("least <> root")
    near = near.select(F.least("least", "root").alias("a"), F.greatest("least", "root").alias("b"))
    return stored(sure.unionByName(near).distinct(), "links")


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id`` (least id linked over shared passages, itself included), ``n_links``
    (other texts found to share a passage with it), ``n_copies`` (other rows with the same text of 50 words or more).

    Whole texts, null as empty.  Texts under 50 words have no passage: their rows stand alone, copies or not.  Null
    ids are linked but name no class, unless a class has no other: then class_id is null.  Empty table: no rows.
    """
    links = passage_links(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(text_col).alias("node"), text_bytes(text_col).alias("text")).mapInArrow(
        _long_enough, "doc_id long, node long, passage boolean")
    rows = stored(rows, "rows")
    long_ = rows.filter("passage").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(links).withColumnRenamed("v", "node")
    facts = long_.join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    facts = stored(facts, "facts")
    classes = stored(facts.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("texts")), "roots")
    facts = stored(lookup(facts, classes, ["root"], "texts", facts.count()).select("node", "n", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    out = lookup(rows.filter("passage"), facts, ["node"], "n", rows.count())
    alone = rows.filter(~F.col("passage")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return out.select("doc_id", "class_id", "n_links", (F.col("n") - 1).alias("n_copies")).unionByName(alone)


def _long_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passage = pa.array([len(t.as_py().split()) >= PASSAGE for t in batch.column(2)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), passage], names=["doc_id", "node", "passage"])
