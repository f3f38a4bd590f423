"""Exact deduplication with a sharded cuckoo-filter index of live text digests.

The index maps the SHA-256 of a text to the document that stays and the number of documents that hold it.  A shard
(hash range of digests) is a cuckoo filter of 16-bit tags in buckets of four; next to each tag lies the full digest.
A lookup touches two buckets; a tag hit counts only when the bucket's stored digest is equal.  Full buckets evict,
and when evictions run too long the filter doubles and is refilled from the stored digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import keep_rows, lookup, sha_bytes, shuffle_partitions, stored

SLOTS = 4
MAX_KICKS = 200
#: Digests that one shard is planned for; more rows make more shards.
SHARD_ROWS = 400_000


class CuckooIndex:
    """Live digests of one shard: tag filter plus stored (digest, payload) per slot."""

    def __init__(self, buckets: int = 64):
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.cells: list[list | None] = [None] * (buckets * SLOTS)
        self.size = 0

    @staticmethod
    def _tag(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & self.mask

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """Slot of a live digest or -1.  A tag hit is verified against the digest stored in the bucket."""
        tag, b = self._tag(digest), self._first(digest)
        for bucket in (b, self._other(b, tag)):
            at = bucket * SLOTS
            for i in range(at, at + SLOTS):
                if self.tags[i] == tag and self.cells[i][0] == digest:
                    return i
        return -1

    def get(self, digest: bytes) -> list | None:
        i = self.find(digest)
        return None if i < 0 else self.cells[i]

    def insert(self, cell: list) -> None:
        """Insert a cell ``[digest, ...]`` whose digest is not live yet."""
        while not self._place(cell):
            self._grow()

    def _place(self, cell: list) -> bool:
        tag = self._tag(cell[0])
        b = self._first(cell[0])
        path = []
        for kick in range(MAX_KICKS):
            for bucket in (b, self._other(b, tag)):
                at = bucket * SLOTS
                for i in range(at, at + SLOTS):
                    if not self.tags[i]:
                        self.tags[i], self.cells[i] = tag, cell
                        self.size += 1
                        return True
            i = self._other(b, tag) * SLOTS + kick % SLOTS
            path.append((i, self.tags[i], self.cells[i]))
            (tag, self.tags[i]), (cell, self.cells[i]) = (self.tags[i], tag), (self.cells[i], cell)
            b = i // SLOTS
        for i, old_tag, old_cell in reversed(path):
            self.tags[i], self.cells[i] = old_tag, old_cell
        return False

    def _grow(self) -> None:
        live = [c for c in self.cells if c is not None]
        buckets = (self.mask + 1) * 2
        while True:
            self._reset(buckets)
            if all(self._place(c) for c in live):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        i = self.find(digest)
        if i < 0:
            return False
        self.tags[i], self.cells[i] = 0, None
        self.size -= 1
        return True

    def live(self) -> Iterator[list]:
        return (c for c in self.cells if c is not None)


INDEX_SCHEMA = "digest binary, keep_id long, group_size long, id_rows long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("id_rows", pa.int64())])


def _emit(cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c[j] for c in cells], f.type) for j, f in enumerate(_ARROW)], schema=_ARROW)


def _add(index: CuckooIndex, digest: bytes, keep, n: int, m: int) -> None:
    cell = index.get(digest)
    if cell is None:
        index.insert([digest, keep, n, m])
        return
    cell[2] += n
    if keep == cell[1]:
        cell[3] += m
    elif cell[1] is None or (keep is not None and keep > cell[1]):
        cell[1], cell[3] = keep, m


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the rows of one shard into its filter; give the live entries."""
    index = CuckooIndex()
    for batch in batches:
        for digest, keep, n, m in zip(*(c.to_pylist() for c in batch.columns)):
            _add(index, digest, keep, n, m)
    cells = list(index.live())
    for i in range(0, max(1, len(cells)), 50_000):
        yield _emit(cells[i:i + 50_000])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold each batch before the shuffle, so that a hot digest leaves a task once a batch, not once a row."""
    for batch in batches:
        index = CuckooIndex()
        for digest, keep in zip(*(c.to_pylist() for c in batch.columns)):
            _add(index, digest, keep, 1, 1)
        yield _emit(list(index.live()))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(__id long, __sha binary)`` per row, over whole texts; a null text is the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("__id"), sha_bytes(text_col).alias("__sha"))


def _shards(df: DataFrame, rows: int) -> DataFrame:
    n = max(shuffle_partitions(df.sparkSession), -(-rows // SHARD_ROWS))
    return df.repartition(n, "digest")


def build_index(rows: DataFrame, total: int) -> DataFrame:
    """``(__id, __sha)`` rows -> index table: digest, keep_id (largest id), group_size, id_rows (rows with keep_id)."""
    part = rows.select("__sha", "__id").mapInArrow(_combine, INDEX_SCHEMA)
    return _shards(part, total).mapInArrow(_fold, INDEX_SCHEMA)


def _change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that live entries come before removals and removals before additions; ``lost``: the kept id went."""
    index, lost = CuckooIndex(), set()
    for batch in batches:
        for digest, keep, n, m, kind in zip(*(c.to_pylist() for c in batch.columns)):
            if kind != 1:
                _add(index, digest, keep, n, m)
                continue
            cell = index.get(digest)
            if cell is None:
                continue
            cell[2] -= n
            if cell[2] <= 0:
                index.delete(digest)
            elif keep == cell[1]:  # the largest removed id: the kept one, if that is among them
                cell[3] -= m
                if cell[3] <= 0:
                    lost.add(digest)
    cells = list(index.live())
    for i in range(0, len(cells), 50_000):
        part = cells[i:i + 50_000]
        yield _emit(part).append_column("lost", pa.array([c[0] in lost for c in part]))


def update_index(index: DataFrame, removed: DataFrame, added: DataFrame, live: DataFrame) -> DataFrame:
    """Apply removed and added ``(__id, __sha)`` rows to an index table; ``live`` are the rows after the change.

    A digest whose last document goes is deleted from its filter.  Where the kept id of a digest goes but others stay, the
    largest id among its ``live`` rows takes over; only the rows of such digests are looked at.  Null ids
    keep a digest alive, and are kept where it has no other.
    """
    def keepers(df: DataFrame) -> DataFrame:
        each = df.groupBy(F.col("__sha").alias("digest"), "__id").agg(F.count(F.lit(1)).alias("m"))
        return each.groupBy("digest").agg(F.max(F.struct("__id", "m")).alias("k"), F.sum("m").alias("group_size")).select(
            "digest", F.col("k.__id").alias("keep_id"), "group_size", F.col("k.m").alias("id_rows"))

    both = index.withColumn("kind", F.lit(0)).unionByName(keepers(removed).withColumn("kind", F.lit(1))).unionByName(keepers(added).withColumn("kind", F.lit(2)))
    dealt = both.repartition(shuffle_partitions(index.sparkSession), "digest").sortWithinPartitions("digest", "kind")
    new = stored(dealt.mapInArrow(_change, f"{INDEX_SCHEMA}, lost boolean"), "index")
    lost = new.filter("lost").select("digest")
    again = keepers(live.join(lost.withColumnRenamed("digest", "__sha"), "__sha", "left_semi"))
    return new.filter("not lost").drop("lost").unionByName(again)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; the largest id of a group stays.  Null text = empty text.  A null id counts in
    ``group_size``, is never the one that stays unless the whole group has none (then ``keep_id`` is null) and has
    ``kept`` false.  Rows that repeat id and text are all marked as kept.  Empty table: no rows.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    index = stored(build_index(rows, total), "index")
    facts = index.withColumnRenamed("digest", "__sha")
    out = lookup(rows, facts, ["__sha"], "group_size", total)
    return out.select(
        F.col("__id").alias("doc_id"), "keep_id", "group_size",
        F.coalesce(F.col("__id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all their columns, one row per text.  A text held only by rows without id keeps one of them."""
    rows = stored(digests(docs, id_col, text_col), "digests")
    index = stored(build_index(rows, rows.count()), "index")
    winners = index.select(F.col("keep_id").alias("__id"), F.col("digest").alias("__sha"), F.col("id_rows").alias("__n"))
    return keep_rows(docs, winners, id_col, text_col)
