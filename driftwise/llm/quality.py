"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Two dictionaries are trained, one on pieces of texts with label 1, one on pieces of texts with label 0.  A text is cut
into blocks of ``BLOCK`` bytes; every block is compressed three times: with the good dictionary (G bytes in all), with
the bad one (B) and with none (Z).  A text is like the good ones when B - G is large.  The difference is normalised
twice, by the size of the text and by the compressed sizes, since a text that repeats itself is small under any
dictionary; Z per byte tells the two cases apart.  A logistic curve over these three, fitted on labelled texts that
neither dictionary has seen, turns them into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import stored, text_bytes

#: Labelled rows that the classifier is fitted on at most, in hash order of the id.
TRAIN_ROWS = 50_000
#: Pieces of text (of PIECE bytes at most) that a dictionary is trained on at most, in hash order.
PIECES = 8_000
PIECE = 1024
DICTIONARY_BYTES = 112_640
BLOCK = 512
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    """Dictionaries (empty: none) and the logistic curve; ``share`` is the score of a text without bytes."""

    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)
    centre: list[float] = field(default_factory=lambda: [0.0] * 3)
    scale: list[float] = field(default_factory=lambda: [1.0] * 3)
    share: float = 0.5

    def __getstate__(self):  # compressors stay in the process that made them
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        made = []
        for raw in (self.good, self.bad, b""):
            if not raw:
                made.append(zstandard.ZstdCompressor(**plain))
                continue
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=known, **plain))
        return made

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        """Compressed bytes of the whole text with the good, the bad and no dictionary."""
        view = memoryview(text)
        blocks = [view[i:i + BLOCK] for i in range(0, len(text), BLOCK)]
        return tuple(sum(len(c.compress(b)) for b in blocks) for c in self.compressors)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - np.array(self.centre)) / np.array(self.scale)]
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights), -500, 500)))


def differences(good: np.ndarray, bad: np.ndarray, plain: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Normalised differences of texts with n > 0 bytes: by size, by compressed size; and the plain ratio."""
    good, bad, plain, n = (np.asarray(v, float) for v in (good, bad, plain, n))
    return np.stack([(bad - good) / n, (bad - good) / (bad + good), plain / n], 1)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``(h, label, text)``: at most ``rows`` labelled, not held-out documents; ``h`` is a hash of the id.

    Several labels of an id: the largest counts.  Null ids and labels train nothing.  Of equal texts one is used, the
    one with the smallest id, with the largest label among them.  Ids and labels (16 bytes each, ``rows`` at most) are broadcast.
    """
    own = labels.select(F.col(id_col).cast("long").alias("__id"), (F.col(label_col) > 0).cast("int").alias("label"))
    own = own.filter("__id is not null and label is not null").groupBy("__id").agg(F.max("label").alias("label"))
    own = own.filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), text_bytes(text_col).alias("text")).filter(F.octet_length("text") > 0)
    once = texts.join(F.broadcast(own), "__id").select("__id", "label", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(
        F.min("__id").alias("__id"), F.max("label").alias("label"))
    chosen = stored(once, "quality-train").select("__id", "label")
    found = texts.join(F.broadcast(chosen), "__id").dropDuplicates(["__id"])  # an id may come with several texts
    return found.select(F.xxhash64("__id").alias("h"), "label", "text")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, label, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            cut = [text[i:i + PIECE] for i in range(0, len(text), PIECE)]
            order = (np.arange(len(cut), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(h % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(cut), pa.int32()), pa.array((order >> np.uint64(1)).astype(np.int64)), pa.array(cut, pa.binary())],
                                             names=["label", "at", "piece"])


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained dictionary of the pieces; from too few pieces to train on, their plain content; from none, none."""
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(pieces)[-size:]
        return raw if len(raw) >= 8 else b""


def _measured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = differences(*np.array([model.sizes(t) for t in texts]).T, [len(t) for t in texts]) if texts else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        rows: int = TRAIN_ROWS, pieces: int = PIECES) -> Model:
    """Dictionaries from three quarters of the training rows, the curve from the rest.

    To the driver come at most ``pieces`` pieces of each label (PIECE bytes each) and four numbers a curve row, ``rows``
    at most.  With labels of one kind only, or none, every score is the smoothed share of label 1.
    """
    train = stored(training_rows(docs, labels, id_col, text_col, label_col, rows), "quality-rows")
    apart = F.pmod(F.xxhash64("h"), F.lit(4)) == 0
    # a piece is taken by its hash, at a share that gives about 1.1 times enough: so no partition sends more than its part
    sizes = train.filter(~apart).groupBy("label").agg(F.sum(F.ceil(F.octet_length("text") / PIECE))).collect()
    share = {label: min(1.0, 1.1 * pieces / n) for label, n in sizes}
    cut = train.filter(~apart).mapInArrow(_pieces, "label int, at long, piece binary")
    least = F.when(F.col("label") == 0, share.get(0, 1.0)).otherwise(share.get(1, 1.0)) * float(2**63)
    cut = stored(cut.filter(F.col("at") <= least), "quality-pieces")
    taken = [[bytes(r.piece) for r in cut.filter(f"label = {k}").orderBy("at", "piece").limit(pieces).collect()] for k in (0, 1)]
    bad, good = (dictionary(p) for p in taken)
    model = Model(good, bad)
    seen = train.filter(apart).select("label", "text").mapInArrow(_measured(model), "label int, x array<double>").collect()
    y = np.array([r.label for r in seen], float)
    model.share = float((y.sum() + 1) / (len(y) + 2))
    if not taken[0] or not taken[1] or len(set(y)) < 2:
        kinds = dict(train.groupBy("label").count().collect())
        model.share = (kinds.get(1, 0) + 1) / (sum(kinds.values()) + 2)
        model.weights = [float(np.log(model.share / (1 - model.share))), 0.0, 0.0, 0.0]
        return model
    x = np.array([r.x for r in seen])
    model.centre, model.scale = x.mean(0).tolist(), np.maximum(x.std(0), 1e-9).tolist()
    model.weights = logistic((x - np.array(model.centre)) / np.array(model.scale), y).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) by damped Newton steps; Platt's smoothed targets and a small ridge keep them finite."""
    design = np.c_[np.ones(len(x)), x]
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    own = ridge * np.r_[1e-6, np.ones(x.shape[1])]

    def loss(w):
        m = design @ w
        return (np.logaddexp(0, m) - target * m).sum() + (own * w * w).sum() / 2

    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(own + 1e-9), design.T @ (p - target) + own * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


_MEASURES = "struct<score: double, good_bytes: long, bad_bytes: long, plain_bytes: long>"


def scorer(model: Model):
    """Arrow UDF of UTF-8 text -> probability of label 1 and the three compressed sizes of the whole text."""
    kind = pa.struct([("score", pa.float64()), ("good_bytes", pa.int64()), ("bad_bytes", pa.int64()), ("plain_bytes", pa.int64())])

    @F.arrow_udf(_MEASURES)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            n, sizes = np.zeros(len(batch), np.int64), np.zeros((len(batch), 3), np.int64)
            for i, text in enumerate(batch):
                raw = text.as_py()
                n[i], sizes[i] = len(raw), model.sizes(raw)
            p = np.full(len(batch), model.share)
            if (full := n > 0).any():
                p[full] = model.probability(differences(*sizes[full].T, n[full]))
            yield pa.StructArray.from_arrays([pa.array(p), *(pa.array(sizes[:, i]) for i in range(3))], fields=list(kind))

    return score


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``__quality``: score, good_bytes, bad_bytes, plain_bytes.  Null text = empty text = model.share."""
    return docs.withColumn("__quality", scorer(model)(text_bytes(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, good_bytes, bad_bytes, plain_bytes``.

    Null and empty texts score the share of label 1; repeated rows score alike; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = score_documents(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__quality.*")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
