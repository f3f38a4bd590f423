"""Conversation structure repair: a DP over rows whose audits (edit strings) are persistent linked nodes.

Rows of a conversation are edited until their roles read ``(s?(ua)+)?`` by initials: K keeps a row, R gives it the role
user or assistant, D deletes it, I inserts a row without text.  The DP has four states: nothing yet (0), after s (1), after u
(2), after a (3).  Per row and state the cheapest audit survives, ties go to the ASCII-least.  Audits share their
prefixes: a node holds its parent, the piece it adds (inserts and the letter of one row), a rolling hash of the whole
audit and its ancestors 1, 2, 4, ... pieces back.  All nodes of a row have the same number of pieces, so two audits are
compared by lifting both to the first piece in which their hashes differ; an equal hash there is verified.

Why the least prefix may be kept: at one row and state, audits of equal cost cannot be a prefix of each other (the longer one would
hold more inserts, which cost), so their order stays whatever follows.  Inserts before a D are never needed: after
it they cost the same and D comes before I.

Conversations beyond BLOCK_ROWS rows or BLOCK_BYTES of text are cut into blocks that are dealt to many tasks.  A block
gives the cheapest audit for each state before and after it; the blocks of a conversation are joined by the same DP with
blocks for rows.  Only these summaries, about the length of the audits, and last the repaired text as a stream for its hash,
pass through one task, since audit and hash are one value per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import lookup, stored

#: A conversation with more rows, or more bytes of text, is worked on in blocks of that size.
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
SPACE = " \t\n\x0b\f\r"
#: Adjacent initials that are in order.
IN_ORDER = {"su", "ua", "au"}
ROLE = {USER: "user", ASSISTANT: "assistant"}

_PRIME, _BASE = (1 << 61) - 1, 0x5DEECE66D1234567
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Audit:
    """A persistent edit string: ``piece`` after the string of ``parent``; ``up[k]`` is the node 2 ** k pieces back."""

    __slots__ = ("parent", "piece", "depth", "hash", "up")

    def __init__(self, parent: Audit | None = None, piece: str = ""):
        self.parent, self.piece = parent, piece
        self.depth = parent.depth + 1 if parent else 0
        h = parent.hash if parent else 0
        for c in piece.encode():
            h = (h * _BASE + c + 1) % _PRIME
        self.hash = h
        self.up = up = []
        while parent is not None:
            up.append(parent)
            k = len(up) - 1
            parent = parent.up[k] if len(parent.up) > k else None

    def pieces(self) -> list[str]:
        out, node = [], self
        while node.parent is not None:
            out.append(node.piece)
            node = node.parent
        return out[::-1]

    def __str__(self) -> str:
        return "".join(self.pieces())


def same(a: Audit, b: Audit) -> bool:
    """Whether two nodes of equal depth hold the same string; an equal hash is verified back to the first shared node."""
    if a is b:
        return True
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.piece != b.piece:
            return False
        a, b = a.parent, b.parent
    return True


def less(a: Audit, b: Audit) -> bool:
    """ASCII order of two audits over the same rows (equal depth)."""
    if same(a, b):
        return False
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and not same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a.piece < b.piece  # their parents hold the same string


#: States before a row that becomes u or a, with the inserts needed ahead of it.
_TO_USER = [(START, 0), (SYSTEM, 0), (ASSISTANT, 0), (USER, 1)]
_TO_ASSISTANT = [(USER, 0), (START, 1), (SYSTEM, 1), (ASSISTANT, 1)]


def edits(initial: str, faulty: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """Moves ``(state before, state after, cost, piece)`` that consume one row."""
    moves = [(s, s, DELETE, "D") for s in range(4)]
    if faulty:
        return moves
    more = TRUNCATED if truncated else 0
    for after, letter, ways in ((USER, "u", _TO_USER), (ASSISTANT, "a", _TO_ASSISTANT)):
        edit, cost = ("K", more) if initial == letter else ("R", REROLE + more)
        moves += [(s, after, INSERT * j + cost, "I" * j + edit) for s, j in ways]
    if initial == "s":
        moves.append((START, SYSTEM, more, "K"))
    return moves


_MOVES: dict[tuple[str, bool, bool], list] = {}


def moves_of(initial: str, faulty: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    key = (initial if initial in ("s", "u", "a") else "", faulty, truncated)
    if key not in _MOVES:
        _MOVES[key] = edits(*key)
    return _MOVES[key]


Front = dict[int, tuple[int, Audit]]


def advance(front: Front, moves: Iterable[tuple[int, int, int, str]]) -> Front:
    """Cheapest audit per state after one more row (or block): ties ASCII-least."""
    best: dict[int, tuple[int, Audit, str]] = {}
    for before, after, cost, piece in moves:
        if before not in front:
            continue
        paid, node = front[before]
        new, old = (paid + cost, node, piece), best.get(after)
        if old is None or new[0] < old[0] or new[0] == old[0] and (piece < old[2] if node is old[1] else less(node, old[1])):
            best[after] = new
    return {s: (cost, Audit(node, piece)) for s, (cost, node, piece) in best.items()}


def finish(front: Front) -> tuple[int, Audit, str]:
    """Cheapest accepted ``(cost, audit, last inserts)``."""
    ends = []
    for state, last in ((START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II")):
        if state in front:
            cost, node = front[state]
            ends.append((cost + INSERT * len(last), node, last))
    best = ends[0]
    for e in ends[1:]:
        if e[0] < best[0] or e[0] == best[0] and less(e[1], best[1]):
            best = e
    return best


class Rows:
    """Rows of a conversation or of a block of one, in order: faults, texts and the moves of the DP."""

    def __init__(self):
        self.kept: list[tuple[str, str]] = []
        self.moves: list[list] = []
        self.turns: list[int] = []
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.bytes = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        """fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        initial = role[:1]
        if self.kept and self.kept[-1][0][:1] + initial not in IN_ORDER:
            self.counts[3] += 1
        if fault:
            self.counts[fault - 1] += 1
        self.kept.append((role, text))
        self.moves.append(moves_of(initial, fault in (1, 2), fault == 3))
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.bytes += len(text) + 64

    def run(self, state: int) -> Front:
        front = {state: (0, Audit())}
        for m in self.moves:
            front = advance(front, m)
        return front


def repaired(audit: str, rows: Iterable[tuple[str, str]], state: int) -> list[str]:
    """Lines ``role:text`` that an audit makes of rows, from the given state on."""
    out, rows = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = ASSISTANT if state == USER else USER
            out.append(f"{ROLE[state]}:")
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            role = role if edit == "K" else ROLE[state]
        out.append(f"{role}:{text}")
    return out


def whole(conv_id: int | None, rows: Rows) -> tuple:
    """Result row of a conversation that is held whole."""
    cost, node, last = finish(rows.run(START))
    audit = str(node) + last
    lines = "\n".join(repaired(audit, rows.kept, START))
    turns = rows.turns
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    return (conv_id, gaps, *rows.counts, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, natively: ``key, conv_id, turn, role, text, times, fault, bytes`` and the sort keys ``first, second, scan``.

    times: 0 for a dropped row, 2 for a repeated one.  fault: 1 blank, 3 truncated, else 0; duplicates need their
    conversation.  Nulls of role and text, and of the parts of the key, are one space.  Rows of one turn come by their
    original role and text, equal rows together.
    """
    def space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    got = conversations.select(
        F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), space("role").alias("first"), space("text").alias("second"), code.alias("code"))
    text = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("second", ".!?", "")).otherwise(F.col("second"))
    got = got.select("key", "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("first")).alias("role"), text.alias("text"),
                     F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("times"), "first", F.sha2(F.col("second"), 256).alias("second"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", 1).when(~(end.endswith(".") | end.endswith("!") | end.endswith("?")), 3).otherwise(0)
    return got.withColumn("fault", fault).withColumn("bytes", F.octet_length("text")).withColumn("scan", F.monotonically_increasing_id())


#: Rows of a conversation stand together, by turn, then original role and text.
ORDER = ["key", "turn", "first", "second", "scan"]


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ORDER]


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of conversations, whose rows come together and in order."""
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = [x.split()[0] for x in RESULT.split(", ")]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    key, rows, seen, conv, out = None, Rows(), set(), None, []
    for batch in batches:
        for k, c, turn, role, text, times, fault in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if k != key:
                if key is not None:
                    out.append(whole(conv, rows))
                key, conv, rows, seen = k, c, Rows(), set()
            for _ in range(times):
                mark = (role, text)
                rows.add(turn, role, text, 2 if fault != 1 and mark in seen else fault)
                seen.add(mark)
        if out:
            yield batch_of(out)
            out = []
    if key is not None:
        yield batch_of([whole(conv, rows)])


_BLOCK = ("key string, conv_id long, part long, seq long, counts array<long>, first string, last string, turns array<long>, "
          "moves array<struct<before: int, after: int, cost: long, piece: string>>, roles array<string>, texts array<string>")


def _blocks(block_rows: int, block_bytes: int):
    """Blocks of long conversations from rows in order: counts, first and last initial, [least, most, distinct turns], moves, rows."""
    names = ["key", "conv_id", "part", "seq", "counts", "first", "last", "turns", "moves", "roles", "texts"]
    move = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("piece", pa.string())])
    types = [pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(move), *[pa.list_(pa.string())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"key": None, "rows": Rows(), "seq": 0}

        def block() -> pa.RecordBatch:
            rows, k = state["rows"], state["key"]
            moves = [{"before": s, "after": t, "cost": cost, "piece": str(node)} for s in range(4) for t, (cost, node) in rows.run(s).items()]
            kept, turns = rows.kept, rows.turns
            one = (k[0], k[1], k[2], state["seq"], rows.counts, kept[0][0][:1] if kept else None, kept[-1][0][:1] if kept else None,
                   [turns[0], turns[-1], len(turns)] if turns else [], moves, [r for r, _ in kept], [t for _, t in kept])
            state["rows"], state["seq"] = Rows(), state["seq"] + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types)], names=names)

        for batch in batches:
            for k, c, part, turn, role, text, times, fault, again in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (k, c, part) != state["key"]:
                    if state["key"] is not None:
                        yield block()
                    state["key"] = (k, c, part)
                for i in range(times):
                    if len(state["rows"].kept) >= block_rows or state["rows"].bytes >= block_bytes:
                        yield block()
                    state["rows"].add(turn, role, text, 2 if fault != 1 and (again or i) else fault)
        if state["key"] is not None:
            yield block()

    return run


class _Chain:
    """The blocks of one conversation, joined one after the other."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.front = conv_id, {START: (0, Audit())}
        self.at: list[tuple[int, int]] = []
        self.counts, self.last, self.turns = [0, 0, 0, 0], None, []

    def add(self, part, seq, counts, first, last, turns, moves) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if first is not None:
            self.counts[3] += self.last is not None and self.last + first not in IN_ORDER
            self.last = last
        if turns:
            if self.turns:
                turns = [self.turns[0], turns[1], self.turns[2] + turns[2] - (self.turns[1] == turns[0])]
            self.turns = turns
        self.front = advance(self.front, [(m["before"], m["after"], m["cost"], m["piece"]) for m in moves])
        self.at.append((part, seq))

    def result(self) -> tuple[tuple, list[tuple]]:
        cost, node, last = finish(self.front)
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        pieces = node.pieces()
        pieces[-1] += last
        return (self.conv_id, gaps, *self.counts, cost, "".join(pieces)), [(*at, p) for at, p in zip(self.at, pieces)]


_JOINED = "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, part long, seq long, piece string"


def state_after(audit: str, initials: Iterable[str], state: int) -> int:
    """State of the DP after an audit over rows with these initials."""
    rows = iter(initials)
    for edit in audit:
        initial = next(rows) if edit != "I" else ""
        if edit != "D":
            state = SYSTEM if edit == "K" and initial == "s" else ASSISTANT if state == USER else USER
    return state


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation (part null) and one per block with its piece of the audit, from blocks in order."""
    types = [pa.string(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _JOINED.split(", ")]

    def rows_of(key: str, chain: _Chain) -> pa.RecordBatch:
        head, pieces = chain.result()
        out = [(key, *head, None, None, None)] + [(key, head[0], *[None] * 7, *p) for p in pieces]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    key, chain = None, None
    for batch in batches:
        for k, c, *block in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if k != key:
                if key is not None:
                    yield rows_of(key, chain)
                key, chain = k, _Chain(c)
            chain.add(*block)
    if key is not None:
        yield rows_of(key, chain)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, repaired_sha256)``: the repaired lines of a conversation's blocks in order, hashed as a stream."""
    def one(key: str, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    key, digest, state, any_line = None, None, START, False
    for batch in batches:
        for i in range(batch.num_rows):  # a block at a time
            k, piece, roles, texts = (batch.column(j)[i].as_py() for j in range(4))
            if k != key:
                if key is not None:
                    yield one(key, digest)
                key, digest, state, any_line = k, hashlib.sha256(), START, False
            lines = repaired(piece, zip(roles, texts), state)
            if lines:
                digest.update(("\n" * any_line + "\n".join(lines)).encode())
                any_line = True
            state = state_after(piece, (r[:1] for r in roles), state)
    if key is not None:
        yield one(key, digest)


def _long(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Results of long conversations, block by block."""
    keys = _order()
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("mark", F.sha2(F.concat_ws("\x00", "key", F.sha2("role", 256), F.sha2("text", 256)).cast("binary"), 256)), "conv-dealt")
    live = dealt.filter("times > 0")
    firsts = live.groupBy("mark").agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__copies")).filter("__copies > 1")
    marked = lookup(live.select("mark", "at"), stored(firsts, "conv-firsts"), ["mark"], "__copies", live.count())
    again = marked.filter("at > __first").select("at", F.lit(True).alias("again"))
    part = F.shiftright("at", 33)
    ordered = dealt.join(again, "at", "left").withColumn("part", part).repartition("part").sortWithinPartitions("at")
    blocks = stored(ordered.select("key", "conv_id", "part", "turn", "role", "text", "times", "fault", F.coalesce("again", F.lit(False)).alias("again"))
                    .mapInArrow(_blocks(block_rows, block_bytes), _BLOCK), "conv-blocks")
    summaries = blocks.select("key", "conv_id", "part", "seq", "counts", "first", "last", "turns", "moves")
    joined = stored(summaries.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(_joined, _JOINED), "conv-joined")
    texts = blocks.join(joined.filter("part is not null").select("key", "part", "seq", "piece"), ["key", "part", "seq"])
    hashes = texts.select("key", "part", "seq", "piece", "roles", "texts").repartition("key").sortWithinPartitions("key", "part", "seq")
    hashes = hashes.select("key", "piece", "roles", "texts").mapInArrow(_hashed, "key string, repaired_sha256 string")
    return joined.filter("part is null").join(hashes, "key").select(*[x.split()[0] for x in RESULT.split(", ")])


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per ``conv_id`` (null is one): gaps, fault counts, cost, audit and SHA-256 of the repaired conversation.

    A conversation without rows after damage has zeros, an empty audit and the hash of the empty text.  Null roles and
    texts are one space, null turns come first and count in no gap; repeated rows are duplicates; extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = stored(damaged(conversations), "conv-damaged")
    sizes = rows.groupBy("key").agg(F.sum("times").alias("rows"), F.sum(F.col("bytes") * F.col("times")).alias("bytes"))
    long_ = stored(sizes.filter((F.col("rows") > block_rows) | (F.col("bytes") > block_bytes)).select("key"), "conv-long")
    some = not long_.isEmpty()
    short = (rows.join(long_, "key", "left_anti") if some else rows).repartition("key").sortWithinPartitions(*_order())
    got = short.select("key", "conv_id", "turn", "role", "text", "times", "fault").mapInArrow(_by_conversation, RESULT)
    return got.unionByName(_long(rows.join(long_, "key", "left_semi"), block_rows, block_bytes)) if some else got
