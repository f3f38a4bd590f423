"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Text is cut by the byte-level pattern into pre-tokens; each pre-token's bytes are merged by rank.  How far a merge can
be influenced from the right is bounded by the merge list itself (``sufficient_lookahead``), so a transducer that
holds that many bytes back emits every earlier token for good.  Memory stays constant however long a text, a run of
letters or a run of spaces is.  A pre-token shorter than the lookahead is one step: its ids are the only path of tokens
in which each may follow the one before.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import text_bytes

#: Characters of text taken at a time, and pre-token length from which it is streamed.
PIECE = 1 << 16
LONG = 1 << 12
#: Pre-tokens kept with their ids in a worker; the cache starts anew when full.
CACHE_WORDS = 300_000
#: Token pairs whose fit is kept.
CACHE_PAIRS = 300_000
_NO_RANK = 1 << 60


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _patterns() -> tuple[re.Pattern, dict[str, re.Pattern], re.Pattern, frozenset[str]]:
    """The byte-level pre-token pattern, the pattern of each kind of run, a plain pattern, and what that may not meet.

    ``re`` counts letter-like and other numbers (categories Nl, No) as word characters and some control characters as
    white space, so the exact classes spell them out.  Texts without such characters take the plain classes.
    """
    def chars(test) -> set[str]:
        return {c for c in map(chr, range(0x110000)) if test(c)}

    other = chars(lambda c: unicodedata.category(c) in ("Nl", "No"))
    mark = chars(lambda c: c.isalnum() and unicodedata.category(c)[0] not in "LN")
    blank = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    space = re.compile(f"[{blank}]")
    odd = frozenset(other | mark | chars(lambda c: c.isspace() and not space.match(c)))
    spelt = ["".join(map(re.escape, sorted(x))) for x in (other, mark)]

    def build(letter: str, number: str, sign: str, space: str, filled: str):
        runs = {"L": letter + "+", "N": number + "+", "P": sign + "+", "S": space + "+"}
        cut = f"'s|'t|'re|'ve|'m|'ll|'d| ?{runs['L']}| ?{runs['N']}| ?{runs['P']}|{space}+(?!{filled})|{space}+"
        return re.compile(cut), {k: re.compile(v) for k, v in runs.items()}

    exact, runs = build(f"[^\\W\\d_{spelt[0]}{spelt[1]}]", f"[\\d{spelt[0]}]", f"(?:[^\\w{blank}]|[_{spelt[1]}])", f"[{blank}]", f"[^{blank}]")
    plain, _ = build("[^\\W\\d_]", "\\d", "(?:[^\\s\\w]|_)", "\\s", "\\S")
    return exact, runs, plain, odd


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: bytes):
        conf = json.loads(spec)
        model, pre = conf["model"], conf["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or conf["normalizer"]:
            raise ValueError("a byte-level BPE without prefix space and normalizer is needed")
        vocab = model["vocab"]
        chars = _byte_chars()
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        self.merges: dict[int, int] = {}
        self.products: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = (vocab[a], vocab[b])
            self.merges[pair[0] << 32 | pair[1]] = len(self.parts)
            self.parts.append(pair)
            self.products.append(vocab[a + b])
        self.rank_of = dict(zip(self.products, range(len(self.products))))
        self.specials = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = b"".join(back[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.ready = False

    def for_encoding(self) -> Vocabulary:
        """Make what only encoding needs, once."""
        if self.ready:
            return self
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pattern, self.runs, self.plain, self.odd = _patterns()
        self.lookahead = sufficient_lookahead(self)
        self.token = {b: i for i, b in enumerate(self.bytes_of) if b and b not in map(str.encode, self.specials) and self.merge(b) == [i]}
        self.longest: dict[bytes, int] = {}
        for b in self.token:
            self.longest[b[:4]] = max(len(b), self.longest.get(b[:4], 0))
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)
        self.ready = True
        return self

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand right of token a: no merge across their border came before their own merges.

        Undo the later merge of the two, again and again; a merge across the border of a lower rank than the one just
        undone would have come first.  Of equal ranks the left one came first, so the right token is undone first.
        """
        key, limit = a << 32 | b, _NO_RANK
        known = self.pairs.get(key)
        if known is not None:
            return known
        while True:
            rank = self.merges.get(a << 32 | b, _NO_RANK)
            if rank < limit:
                ok = False
                break
            left, right = self.rank_of.get(a, -1), self.rank_of.get(b, -1)
            if left < 0 and right < 0:
                ok = True
                break
            if left > right:
                a, limit = self.parts[left][1], left
            else:
                b, limit = self.parts[right][0], right + 1
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def walk(self, data: bytes) -> list[int]:
        """Token ids of a short byte string as a path of tokens that may follow each other; there is exactly one.

        The state is the last token.  The longest token that may follow is taken; a position from which nothing
        follows is left for good.
        """
        n, at, ids, closed = len(data), 0, [], set()
        token, longest, pairs = self.token.get, self.longest.get, self.pairs
        size = 0  # sizes above this one have been tried at this position (0: none)
        while at < n:
            size = size - 1 if size else min(n - at, longest(data[at:at + 4], 3))
            last = ids[-1] if ids else -1
            while size:
                t = token(data[at:at + size])
                if t is not None and at + size not in closed:
                    ok = last < 0 or pairs.get(last << 32 | t)
                    if ok or (ok is None and self.follows(last, t)):
                        break
                size -= 1
            if size:
                ids.append(t)
                at += size
                size = 0
            else:
                closed.add(at)
                size = len(self.bytes_of[ids.pop()])
                at -= size
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Token ids of a whole byte string: the lowest rank merges first, the leftmost of equals first."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, products = self.merges.get, self.products
        ranks = [get(a << 32 | b, _NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == _NO_RANK:
                break
            i = ranks.index(rank)
            ids[i:i + 2] = [products[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], _NO_RANK)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], _NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, position) over a linked list."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.products[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


def sufficient_lookahead(vocab: Vocabulary) -> int:
    """Bytes to hold back so that no later byte changes an emitted token.

    Compare a buffer with the same buffer and more bytes after it.  Left of some token boundary d both have the same
    tokens; d starts at the end of the buffer.  In rank order, a rule (u, v) moves d left by u's length only if one of
    the two has v at d; then u or uv stands at the new d.  A rule (t, w) may turn t at d into tw.  ``reach[t]`` is the
    farthest that d can have moved with t at d after the rules so far; it only grows in rank order.
    """
    reach = dict.fromkeys(vocab.byte_ids, 0)
    length = {i: 1 for i in vocab.byte_ids}
    for (u, v), m in zip(vocab.parts, vocab.products):
        length[m] = length[u] + length[v]
        moved = reach.get(v, 0) + length[u]
        reach[m] = max(reach.get(m, 0), reach.get(u, 0), moved)
        reach[u] = max(reach.get(u, 0), moved)
    return max(reach.values())


_CONTROLS = re.compile("[\x1c-\x1f]")


class _Words(dict):
    """Pre-token -> its ids as packed little-endian 32-bit integers."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        data = word.encode()
        if len(data) > LONG:
            run = Transducer(self.vocab)
            return run.feed(data) + run.finish()
        packed = _pack(self.vocab.walk(data) if len(data) <= 64 else self.vocab.merge(data))
        if len(data) <= 64:
            self[word] = packed
        return packed


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()


_LITTLE = np.little_endian and array("I").itemsize == 4


class Transducer:
    """Bytes of one pre-token in, packed ids out as soon as they are stable."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab.for_encoding()
        self.held = bytearray()

    def feed(self, data: bytes) -> bytes:
        out, most, at = [], max(LONG, 4 * self.vocab.lookahead), 0
        while at < len(data):
            take = max(1, most - len(self.held))
            self.held += data[at:at + take]
            at += take
            if len(self.held) >= most:
                out.append(self._emit(len(self.held) - self.vocab.lookahead))
        return b"".join(out)

    def _emit(self, stable: int) -> bytes:
        ids, end, n = self.vocab.merge(bytes(self.held)), 0, 0
        for i in ids:
            size = len(self.vocab.bytes_of[i])
            if end + size > stable:
                break
            end, n = end + size, n + 1
        del self.held[:end]
        return _pack(ids[:n])

    def finish(self) -> bytes:
        return self._emit(len(self.held))


class StreamEncoder:
    """Text pieces in, packed ids out; the same ids however the text is cut into pieces."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.tail, self.run, self.kind = vocab.for_encoding(), "", None, ""

    def feed(self, piece: str) -> bytes:
        return self._take(self.tail + piece, False)

    def finish(self) -> bytes:
        return self._take(self.tail, True)

    def _take(self, text: str, last: bool) -> bytes:
        out, at, marks = [], 0, self.vocab.special_pattern
        for m in marks.finditer(text) if marks else ():
            out.append(self._plain(text[at:m.start()], True))
            out.append(_pack([self.vocab.specials[m.group()]]))
            at = m.end()
        rest = text[at:]
        keep = 0
        if not last:  # a special token may have begun
            keep = max((k for s in self.vocab.specials for k in range(1, len(s)) if rest.endswith(s[:k])), default=0)
        body = rest[:len(rest) - keep]
        out.append(self._plain(body, last))
        self.tail += rest[len(rest) - keep:] if keep else ""
        return b"".join(out)

    def _plain(self, text: str, last: bool) -> bytes:
        """Text without special tokens; what is not stable yet goes to ``tail``."""
        out = []
        if self.run is not None:
            end = m.end() if (m := self.vocab.runs[self.kind].match(text)) else 0
            if end == len(text) and not last:
                out.append(self.run.feed(text[:max(0, end - 1)].encode()))
                self.tail = text[max(0, end - 1):]
                return b"".join(out)
            if self.kind == "S" and end < len(text):
                end -= 1  # the last space belongs to what follows
            out.append(self.run.feed(text[:end].encode()) + self.run.finish())
            self.run, text = None, text[end:]
        pattern = self.vocab.plain if text.isascii() and not _CONTROLS.search(text) or self.vocab.odd.isdisjoint(set(text)) else self.vocab.pattern
        words = pattern.findall(text)
        rest = 0
        if not last:  # 3 characters show whether an apostrophe starts a contraction
            while words and rest < 3:
                rest += len(words.pop())
        out.append(b"".join(map(self.vocab.words.__getitem__, words)))
        self.tail = text[len(text) - rest:]
        if rest > LONG:
            self._open(out)
        return b"".join(out)

    def _open(self, out: list[bytes]) -> None:
        """A pre-token that has grown long goes on as a run of its kind; its last character waits."""
        first = self.vocab.pattern.match(self.tail)
        if first.end() < LONG or first.end() < len(self.tail):
            return
        self.kind = next(k for k, p in self.vocab.runs.items() if p.match(self.tail[-1]))
        self.run = Transducer(self.vocab)
        out.append(self.run.feed(self.tail[:-1].encode()))
        self.tail = self.tail[-1]


class StreamDecoder:
    """Packed ids in, text out: a byte-to-text state machine that keeps at most three bytes of an open character."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return self.state.decode(b"".join(map(self.vocab.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[int, Vocabulary] = {}


def load(spec: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, made once in each process."""
    key = zlib.crc32(spec)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


def encode_text(vocab: Vocabulary, text: str) -> bytes:
    enc = StreamEncoder(vocab)
    out = [enc.feed(text[i:i + PIECE]) for i in range(0, len(text), PIECE)]
    return b"".join([*out, enc.finish()])


def decode_ids(vocab: Vocabulary, packed: bytes) -> str:
    dec = StreamDecoder(vocab)
    out = [dec.feed(packed[i:i + 4 * PIECE]) for i in range(0, len(packed), 4 * PIECE)]
    return "".join([*out, dec.finish()])


#: Bytes of results after which a task hands on a batch.
BATCH_BYTES = 4 << 20
_IDS, _TEXT = ("binary", pa.binary()), ("string", pa.string())


def _apply(df: DataFrame, path: str, source: str, outputs: dict[str, tuple[str, pa.DataType]], fn) -> DataFrame:
    """Replace ``source`` by the output columns ``fn(vocabulary, value)`` gives; other columns pass."""
    spec = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # one vocabulary file: a few MB
    rest = [c for c in df.columns if c != source]
    names = [*rest, *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(spec.value)
        for batch in batches:
            column, start, size, done = batch.column(source), 0, 0, []
            for i, x in enumerate(column):
                done.append(fn(vocab, x.as_py()))
                size += sum(map(len, done[-1]))
                if size >= BATCH_BYTES or i + 1 == len(column):
                    own = [pa.array([d[k] for d in done], kind) for k, (_, kind) in enumerate(outputs.values())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(done)) for c in rest), *own], names=names)
                    start, size, done = i + 1, 0, []

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != source]
    return df.mapInArrow(run, ", ".join([*kept, *(f"`{name}` {kind}" for name, (kind, _) in outputs.items())]))


def encode(df: DataFrame, path: str, text_col: str = "__text", ids_col: str = "__ids") -> DataFrame:
    """Replace the UTF-8 ``text_col`` (binary, not null) by ``ids_col``: ids as packed little-endian unsigned 32-bit integers."""
    return _apply(df, path, text_col, {ids_col: _IDS}, lambda v, x: (encode_text(v, x.decode()),))


def decode(df: DataFrame, path: str, ids_col: str = "__ids", text_col: str = "__decoded") -> DataFrame:
    """Replace the packed ids in ``ids_col`` by the decoded ``text_col``; incomplete UTF-8 becomes U+FFFD."""
    return _apply(df, path, ids_col, {text_col: _TEXT}, lambda v, x: (decode_ids(v, x),))


def round_trip(df: DataFrame, path: str, text_col: str = "__text", ids_col: str = "__ids", decoded_col: str = "__decoded") -> DataFrame:
    """Replace ``text_col`` by its ids and the text decoded from those ids, in one worker instead of two in a row."""
    def both(vocab: Vocabulary, x: bytes) -> tuple[bytes, str]:
        ids = encode_text(vocab, x.decode())
        return ids, decode_ids(vocab, ids)

    return _apply(df, path, text_col, {ids_col: _IDS, decoded_col: _TEXT}, both)


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Whole texts are encoded, then decoded from their ids.  Null text = empty text: no tokens, digests of the empty
    string.  Null and repeated ids are rows like any other.  Empty table: no rows.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("__text"))
    both = round_trip(rows, path)
    return both.select("doc_id", (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("__ids", 256).alias("ids_sha256"), F.sha2(F.col("__decoded").cast("binary"), 256).alias("decoded_sha256"))
