"""Language identification with language-bitmask n-gram filters.

Byte 4-grams of the normalised text are counted per language over all training documents.  A language keeps the grams
that are frequent in it, also next to the language where they are most frequent.  All languages share bit-sliced
Bloom filters: position p holds a word with one bit per language, so the AND of a gram's positions is the mask of
all languages that contain it.  A text's masks are counted per language, the counts are corrected for the filter's
false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import stored, text_bytes

GRAM = 4
#: log2 of the filter positions, and positions that a gram sets.
BITS, HASHES = 20, 3
#: A gram belongs to a language from this share of the language's grams, and of its share where it is most frequent.
LEAST_SHARE, LEAST_RATIO = 2e-6, 0.1
#: Bytes of normalised text handled at once in a task.
CHUNK = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def normal(text: bytes) -> bytes:
    """ASCII letters in lower case, other ASCII as single spaces, other bytes as they are; a space at both ends."""
    return b" " + b" ".join(text.translate(_TABLE).split()) + b" "


def grams(data: bytes) -> np.ndarray:
    """The byte 4-grams at every position (empty for fewer than four bytes)."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < GRAM:
        return np.empty(0, np.uint32)
    return a[:-3] << np.uint32(24) | a[1:-2] << np.uint32(16) | a[2:-1] << np.uint32(8) | a[3:]


def positions(g: np.ndarray) -> list[np.ndarray]:
    mixed = g ^ (g >> np.uint32(15))
    return [(mixed * m ^ (mixed >> np.uint32(7))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS) for m in _MULTIPLIERS[:HASHES]]


@dataclass
class Model:
    """``filters`` has one row of 2**BITS words for each 64 languages."""

    langs: list[str]
    filters: np.ndarray
    most: str | None = None
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts per language, folded in the task; a language's table holds each distinct gram once."""
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def fold(lang: str, texts: list[bytes]) -> None:
        g, n = np.unique(grams(b"".join(texts)), return_counts=True)
        if lang in seen:
            g, back = np.unique(np.r_[seen[lang][0], g], return_inverse=True)
            n = np.bincount(back, np.r_[seen[lang][1], n]).astype(np.int64)
        seen[lang] = g, n

    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            texts.setdefault(lang, []).append(normal(text))
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= 4 * CHUNK:
                fold(lang, texts.pop(lang))
                size[lang] = 0
        for lang, own in texts.items():
            fold(lang, own)
    for lang, (g, n) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, gram, n)`` over all rows with a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text")).filter("lang is not null")
    return rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _fill(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = np.zeros((words, 1 << BITS), np.uint64)
        for batch in batches:
            g, lang = batch.column(0).to_numpy().astype(np.uint32), batch.column(1).to_numpy()
            for p in positions(g):
                np.bitwise_or.at(filters, (lang // 64, p), np.uint64(1) << (lang % 64).astype(np.uint64))
        for w in range(words):
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([filters[w].tobytes()], pa.binary())], names=["word", "bits"])

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Filters learnt from all rows of ``docs`` with a language; of fixed size (8 MB for each 64 languages)."""
    counts = stored(gram_counts(docs, text_col, lang_col), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = sorted((r.lang, r.total) for r in totals.collect())  # one row per language
    langs = [x for x, _ in known]
    if not langs:
        return Model([], np.zeros((1, 1 << BITS), np.uint64))
    share = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = F.max("share").over(Window.partitionBy("gram"))
    kept = share.withColumn("top", top).filter((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_RATIO * F.col("top")))
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    words = (len(langs) + 63) // 64
    parts = kept.select("gram", number.cast("long").alias("number")).repartition(4).mapInArrow(_fill(words), "word int, bits binary").collect()
    filters = np.zeros((words, 1 << BITS), np.uint64)
    for r in parts:
        filters[r.word] |= np.frombuffer(bytes(r.bits), np.uint64)
    rates = np.array([(filters[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() ** HASHES for i in range(len(langs))])
    return Model(langs, filters, max(known, key=lambda x: (x[1], x[0]))[0], rates)


def counts_of(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of each normalised text and, per language, how many of them its filter holds."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    g = grams(data)
    n = np.maximum(ends - starts - (GRAM - 1), 0)
    p = positions(g)
    inside = np.ones(len(g), np.uint64)
    for k in range(1, GRAM):  # grams that run into the next text
        inside[np.clip(ends - k, 0, len(g) - 1)[ends - k < len(g)]] = 0
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    for w, words in enumerate(model.filters):
        mask = words[p[0]]
        for q in p[1:]:
            mask &= words[q]
        for i in range(64 * w, min(64 * w + 64, len(model.langs))):
            bit = ((mask >> np.uint64(i % 64)) & inside).astype(np.int32)
            total = np.r_[0, np.cumsum(bit, dtype=np.int64)]
            out[:, i] = total[np.minimum(starts + n, len(bit))] - total[np.minimum(starts, len(bit))]
    return n, out


def _predictor(model: Model):
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def chunk(texts: list[bytes]) -> tuple[list, list]:
        n, hits = counts_of(model, texts)
        n = np.maximum(n, 1)[:, None]
        share = np.clip((hits / n - model.rates) / np.maximum(1 - model.rates, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        top, total = share.max(axis=1), share.sum(axis=1)
        names = [model.langs[b] if t > 0 else model.most for b, t in zip(best, top)]
        return names, (top / np.maximum(total, 1e-300)).tolist()

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            langs: list = ["und"] * len(batch)
            scores = [0.0] * len(batch)
            rows, texts, size = [], [], 0

            def flush() -> None:
                if rows:
                    for row, name, score in zip(rows, *chunk(texts)):
                        langs[row], scores[row] = name, score
                rows.clear()
                texts.clear()

            for row, text in enumerate(batch):
                raw = text.as_py()
                if not model.langs or not _LETTER.search(raw.decode()):
                    continue
                rows.append(row)
                texts.append(normal(raw))
                size += len(raw)
                if size >= CHUNK:
                    flush()
                    size = 0
            flush()
            yield pa.array([{"lang_pred": a, "score": b} for a, b in zip(langs, scores)], kind)

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``__lang`` (lang_pred, score).  Whole texts; null or without a letter: ``und``, 0.

    A text none of whose grams is known gets the language with most training text and score 0; of equal shares the
    first language in code-point order wins.
    """
    return docs.withColumn("__lang", _predictor(model)(text_bytes(text_col)))


def language_predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; learnt from the rows that are not held out.

    Repeated rows are predicted alike; a null id is never held out.  Empty table: no rows.
    """
    out = held_out(F.col(id_col).cast("long"))
    model = fit(docs.filter(~out), text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "__lang.lang_pred", "__lang.score")
