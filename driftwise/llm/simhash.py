"""SimHash near-dedup: bit-sliced comparison of fingerprints inside pigeonhole blocks.

Fingerprints within ``radius`` bits agree on at least two of ``radius + 2`` bit bands, so all links lie inside
groups that share a pair of bands.  In a group the fingerprints stand vertically: one 64-lane word per bit holds that
bit of 64 fingerprints.  A fingerprint is compared with 64 others at a time; carry-save counters (ones, twos, over)
add the differing bits of all lanes at once, and blocks whose lanes all exceed the radius are abandoned early.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import keep_rows, lookup, sha_bytes, shuffle_partitions, stored, text_bytes
from driftwise.llm.components import components

BITS = 64
SEED = 42
#: Members beyond which a group is dealt anew by bands of its remaining bits.
GROUP_ROWS = 4096
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text, A-Z in lower case; no words: 0.

    Shingle hashes are XXH64 with seed 42.  Byte histograms of the hashes give the 64 bit counts, so no matrix of
    single bits is built.
    """
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), SEED)]
    elif shingle == 3:
        hashes = [h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [h(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))]
    n = len(hashes)
    rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(n, 8)
    if n < 256:
        ones = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, text = batch.columns
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, fp], names=[*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(__id long, __sha binary, fp long)`` per row over whole texts; null text = empty text."""
    return docs.select(F.col(id_col).cast("long").alias("__id"), sha_bytes(text_col).alias("__sha"), text_bytes(text_col).alias("text")) \
        .mapInArrow(_fingerprints(shingle), "__id long, __sha binary, fp long")


def _bands(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    """Cut bits lo..hi into parts: (first bit, width)."""
    cuts = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _slice(col, band: tuple[int, int]):
    first, width = band
    return F.shiftrightunsigned(col, first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp, bands, chosen):
    return F.xxhash64(F.lit(str(chosen)), *[_slice(fp, bands[i]) for i in chosen])


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``(k, fp)``: groups of two or more fingerprints that hold every pair within the radius.

    A group of more than GROUP_ROWS goes to finer keys: with two bands equal, the differing bits lie in the other
    ``radius`` bands; these are cut into ``radius + 1`` pieces, of which one at least is equal.
    """
    bands = _bands(0, BITS, radius + 2)
    pairs = list(combinations(range(radius + 2), 2))
    keyed = prints.select("fp", F.posexplode(F.array(*[_keys(F.col("fp"), bands, c) for c in pairs])).alias("pair", "k"))
    counts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(counts, "k")
    fine = []
    for number, pair in enumerate(pairs):
        free = [bands[i] for i in range(radius + 2) if i not in pair]
        pieces = [(a, w) for first, width in free for a, w in _bands(first, first + width, 2)] if radius > 1 else [
            x for first, width in free for x in _bands(first, first + width, radius + 1)]
        groups = [pieces[i::radius + 1] for i in range(radius + 1)]
        fine.append(F.array(*[F.xxhash64("k", F.lit(f"{number}.{g}"), *[_slice(F.col("fp"), p) for p in piece]) for g, piece in enumerate(groups)]))
    finer = F.element_at(F.array(*fine), F.col("pair") + 1)
    return keyed.select("fp", F.explode(F.when(F.col("n") > GROUP_ROWS, finer).otherwise(F.array("k"))).alias("k"))


def bit_sliced_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i < j, of rows in the same group (ids ascending) at ``radius`` (0 to 3) or fewer differing bits."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    first = np.repeat(starts, sizes)
    offset = np.arange(n) - first
    blocks_of = (sizes + 63) // 64
    block_base = np.r_[0, np.cumsum(blocks_of)[:-1]]
    block = np.repeat(block_base, sizes) + offset // 64
    lane = (offset % 64).astype(np.uint64)
    nblocks = int(blocks_of.sum())
    planes = np.zeros((BITS, nblocks), np.uint64)
    filled = np.zeros(nblocks, np.uint64)
    np.bitwise_or.at(filled, block, np.uint64(1) << lane)
    for b in range(BITS):
        np.bitwise_or.at(planes[b], block, ((fp >> np.uint64(b)) & np.uint64(1)) << lane)
    block_start = np.zeros(nblocks, np.int64)
    block_start[block[::-1]] = np.arange(n)[::-1]
    # each row meets its own block and the later blocks of its group
    own = block
    last = np.repeat(block_base + blocks_of, sizes)
    meets = last - own
    rows = np.repeat(np.arange(n), meets)
    against = np.arange(len(rows)) - np.repeat(np.cumsum(meets) - meets, meets) + np.repeat(own, meets)
    out_i, out_j = [], []
    step = 1 << 17
    for at in range(0, len(rows), step):
        i, k = rows[at:at + step], against[at:at + step]
        live = filled[k].copy()
        same = k == own[i]
        live[same] &= ~((np.uint64(2) << lane[i[same]]) - np.uint64(1))  # lanes after the row itself
        ones, twos, over = (np.zeros(len(i), np.uint64) for _ in range(3))
        for b in range(BITS):
            if b % 8 == 4:
                on = (live & ~_beyond(ones, twos, over, radius)) != 0
                if not on.all():
                    i, k, live, ones, twos, over = (x[on] for x in (i, k, live, ones, twos, over))
                if not len(i):
                    break
            differ = planes[b][k] ^ (((fp[i] >> np.uint64(b)) & np.uint64(1)) * _FULL)
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
        if not len(i):
            continue
        near = live & ~_beyond(ones, twos, over, radius)
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, c = np.nonzero(bits)
        out_i.append(i[hit[r]])
        out_j.append(block_start[k[hit[r]]] + c)
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _beyond(ones, twos, over, radius: int):
    """Lanes whose count (ones + 2 twos, over: 4 or more) exceeds the radius."""
    return over | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.uint64(0)}[radius]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least linked row of each row's component among rows 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new[new]]
        if (new == root).all():
            return root
        root = new


def _compare(radius: int):
    """Rows come sorted by k; whole groups are compared, a chunk of groups at a time.  Links go out as a star for each
    component inside the chunk, so their number never exceeds that of the rows."""

    def links(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        i, j = bit_sliced_links(k, fp, radius)
        root = spanning(len(fp), i, j)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            k = np.r_[k, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy()]
            if len(k) and k[0] != k[-1]:
                cut = np.searchsorted(k, k[-1])
                yield links(k[:cut], fp[:cut])
                k, fp = k[cut:], fp[cut:]
        yield links(k, fp)

    return run


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> ``(a, b)`` links that span the same components as all pairs within the radius."""
    groups = _grouped(prints, radius)
    dealt = groups.repartition(shuffle_partitions(prints.sparkSession), "k").sortWithinPartitions("k")
    return dealt.select("k", "fp").mapInArrow(_compare(radius), "a long, b long")


def simhash_rows(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"):
    """Stored ``(__id, __sha, fp)`` rows and stored ``(fp, n, component_id, root)`` per distinct fingerprint."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = stored(rows.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    facts = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # one row per distinct fingerprint: the class minimum comes from an aggregate and a join back on the root
    classes = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, stored(facts.join(classes, "root").select("fp", "n", "component_id", "root"), "classes")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (least id reachable over links).

    Documents of equal fingerprint are linked, texts without words (null too) have fingerprint zero and are linked
    like any other.  Null ids are linked but never name a component; a component of null ids only has a null
    component_id.  Repeated rows share a fingerprint.  Empty table: no rows.
    """
    rows, classes = simhash_rows(docs, shingle, radius, id_col, text_col)
    out = lookup(rows, classes, ["fp"], "n", rows.count())
    return out.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the least id (ties: least SHA-256; ids before null)."""
    rows, classes = simhash_rows(docs, shingle, radius, id_col, text_col)
    marked = lookup(rows, classes, ["fp"], "n", rows.count())
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("__id"), F.col("__sha").alias("__sha"))
    each = marked.groupBy("root", "__id", "__sha").agg(F.count(F.lit(1)).alias("__n"))
    best = each.groupBy("root").agg(F.min(F.struct(order.alias("o"), F.col("__n").alias("__n"))).alias("w"))
    winners = stored(best.select("w.o.__id", "w.o.__sha", "w.__n"), "winners")
    return keep_rows(docs, winners, id_col, text_col)
