"""Toxicity: maximum-scoring segments over token log-odds, aggregated by extreme-value calibration.

A word's log-odds compare the share of toxic documents among those that hold it with the overall share.  The shares
have Dirichlet priors in a chain: overall -> first four letters -> first five letters -> word, so rare inflections
lean on their stem.  Each token scores its log-odds less a drift; one linear pass finds all maximal scoring segments
of a text.  Segment scores of clean text follow an extreme-value law (lambda, K); the evidence of a document is the sum
over its significant segments of lambda * S - ln(K * n), and a logistic curve maps evidence to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import packed, stored, text_bytes

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the classifier is fitted on at most, taken in hash order of the id.
TRAIN_ROWS = 50_000
#: Lexicon entries that a model may hold.
MAX_TERMS = 50_000
#: Weight of the parent's share in a word's or stem's share, in documents.
PRIOR = 10.0
LEAST_DOCS = 4
#: Log-odds that a term must have at least, either way, to score.
LEAST_ODDS = 1.0
DRIFT = 0.25
THRESHOLD = 0.7


@dataclass
class Model:
    """Lexicon (word or stem -> log-odds), extreme-value law and logistic curve."""

    words: dict[str, float]
    stems: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    bias: float = 0.0

    def odds(self, word: str) -> float:
        x = self.words.get(word)
        if x is None and len(word) > 4:
            x = self.stems.get(word[:5])
            if x is None:
                x = self.stems.get(word[:4])
        return x or 0.0

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.bias))))


class _Odds(dict):
    """Word -> log-odds, filled on demand and emptied when large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= 500_000:
            self.clear()
        self[word] = x = self.model.odds(word)
        return x


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first token, last token)``; ``hits`` are (token, log-odds) with log-odds <> 0.

    Every token scores its log-odds (0 if no hit) less the drift.  Runs without hits are one step, so the time is
    linear in the hits.
    """
    total, stack = 0.0, []  # candidates: [sum before, sum after, first, last, last one to the left with a lesser sum before]
    at = -1
    for i, odds in hits:
        total -= drift * (i - at - 1)
        at = i
        left, total = total, total + odds - drift
        if odds <= drift:
            continue
        first = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= total:
                stack.append([left, total, first, i, j])
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b - a, f, e) for a, b, f, e, _ in stack]


def passages(model: Model, cache: dict, text: str) -> tuple[int, list[tuple[float, int, int]]]:
    """Words of a text and its significant segments as (evidence, first word, last word)."""
    words = WORD.findall(text.lower())
    scores = list(map(cache.__getitem__, words))
    hits = [(i, s) for i, s in enumerate(scores) if s] if any(scores) else []
    if not hits:
        return len(words), []
    least = math.log(max(model.k * len(words), 1e-300))
    found = ((model.lam * s - least, a, b) for s, a, b in segments(hits, DRIFT))
    return len(words), [x for x in found if x[0] > 0]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """``(label, text)`` of at most ``rows`` labelled documents outside the held-out third.

    The chosen ids and labels (16 bytes each) are broadcast; their number is bounded by ``rows``.  Several labels of an
    id: the largest counts.  Null ids and labels are no training rows.  Of equal texts one is used (with the largest
    label), so that copies do not count as evidence again and again.
    """
    own = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label"))
    own = own.filter("__id is not null and label is not null").groupBy("__id").agg(F.max("label").alias("label"))
    own = own.filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), text_bytes(text_col).alias("text"))
    once = texts.join(F.broadcast(own), "__id").select("__id", "label", F.xxhash64("text").alias("h")).groupBy("h").agg(
        F.min("__id").alias("__id"), F.max("label").alias("label"))
    return texts.join(F.broadcast(stored(once, "train").select("__id", "label")), "__id").select("label", "text")


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, docs = (Counter(), Counter()), [0, 0]
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall(text.decode().lower()))
            seen[label > 0].update(words)
            docs[label > 0] += 1
        seen[0][""], seen[1][""] = docs
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()),
                                          pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "a", "b"])


def _share(a: str, b: str, parent: Column) -> Column:
    return (F.col(a) + PRIOR * parent) / (F.col(a) + F.col(b) + PRIOR)


def _odds(share: Column, base: float) -> Column:
    return F.log(share / (1 - share)) - math.log(base / (1 - base))


def _z(a: str, b: str, base: float) -> Column:
    """Signed-root deviance of a toxic and b clean documents from the overall share: about standard normal if equal."""
    n, x = F.col(a) + F.col(b), F.col(a) / (F.col(a) + F.col(b))

    def part(share: Column, null: float) -> Column:
        return F.when(share > 0, share * F.log(share / null)).otherwise(0.0)

    return F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 * n * (part(x, base) + part(1 - x, 1 - base)))), F.lit(0.0))


def lexicon(train: DataFrame) -> tuple[Model, dict]:
    """Word and stem log-odds of the training rows; at most MAX_TERMS entries reach the driver."""
    counts = stored(train.mapInArrow(_count, "word string, a long, b long").groupBy("word").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")), "words")
    total = counts.filter("word = ''").select("a", "b").first()
    toxic, clean = (total[0], total[1]) if total else (0, 0)
    if not toxic or not clean:
        return Model({}, {}), {"toxic": toxic, "clean": clean, "mass": []}
    base = toxic / (toxic + clean)
    words = counts.filter("word <> ''")
    four = words.filter("length(word) > 4").groupBy(F.substring("word", 1, 4).alias("s4")).agg(F.sum("a").alias("a4"), F.sum("b").alias("b4"))
    five = words.filter("length(word) > 4").groupBy(F.substring("word", 1, 5).alias("s5")).agg(F.sum("a").alias("a5"), F.sum("b").alias("b5"))
    four = four.withColumn("p4", _share("a4", "b4", F.lit(base)))
    five = five.withColumn("s4", F.substring("s5", 1, 4)).join(four, "s4").withColumn("p5", _share("a5", "b5", F.col("p4")))
    long_ = words.withColumn("s5", F.when(F.length("word") > 4, F.substring("word", 1, 5))).join(five, "s5", "left")
    full = long_.withColumn("p", _share("a", "b", F.coalesce(F.col("p5"), F.lit(base))))

    def entry(kind: str, key: str, share: str, a: str, b: str):
        return [F.lit(kind).alias("kind"), F.col(key).alias("key"), _odds(F.col(share), base).alias("odds"), _z(a, b, base).alias("z"),
                (F.col(a) + F.col(b)).alias("n"), F.col(b).alias("clean")]

    parts = full.select(*entry("w", "word", "p", "a", "b"), F.greatest(_z("a5", "b5", base), _z("a4", "b4", base)).alias("up")).unionByName(
        five.select(*entry("s", "s5", "p5", "a5", "b5"), _z("a4", "b4", base).alias("up"))).unionByName(
        four.select(*entry("s", "s4", "p4", "a4", "b4"), F.lit(0.0).alias("up")))
    parts = stored(parts.filter(F.col("n") >= LEAST_DOCS), "terms")
    least_z = math.sqrt(2 * math.log(max(20, parts.count())))  # about the largest of so many standard normals
    # a term under a significant stem is kept too: its share holds the stem's, or its own documents speak against it
    best = parts.filter(F.greatest("z", "up") >= least_z).orderBy(F.greatest("z", "up").desc(), "kind", "key").limit(MAX_TERMS).collect()
    kept = {(r.kind, r.key): r.odds if abs(r.odds) >= LEAST_ODDS else 0.0 for r in best}
    model = Model({k: x for (kind, k), x in kept.items() if kind == "w"}, {k: x for (kind, k), x in kept.items() if kind == "s"})
    mass = [(model.words[r.key], r.clean) for r in best if r.kind == "w" and r.clean and model.words[r.key]]
    return model, {"toxic": toxic, "clean": clean, "mass": mass, "words": words.agg(F.sum("b")).first()[0]}


def _lambda(mass: list[tuple[float, int]], words: int) -> float:
    """Root of sum p exp(lambda s) = 1 over the token scores of clean text; 1, the value of true log-odds, if none is positive."""
    if not any(s > DRIFT for s, _ in mass):
        return 1.0
    s, p = np.array([x for x, _ in mass]) - DRIFT, np.array([n for _, n in mass]) / words
    rest = (1 - p.sum())
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(mid * s)).sum() + rest * math.exp(-mid * DRIFT) > 1 else (mid, hi)
    return min(1.0, max(0.2, lo))


def _best(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Odds(model)
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.decode().lower())
                hits = [(i, s) for i, s in enumerate(map(cache.__getitem__, words)) if s]
                found = segments(hits, DRIFT)
                out.append((int(label > 0), len(words), [x[0] for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["label", "n", "scores"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = TRAIN_ROWS) -> Model:
    """Lexicon, extreme-value law and logistic curve from the labelled documents outside the held-out third.

    Without labels of both kinds every score is the share of toxic labels (0 if there are none).
    """
    train = training_rows(docs, labels, id_col, text_col, label_col, rows)
    model, seen = lexicon(train)
    if not seen["toxic"] or not seen["clean"]:
        model.slope, model.bias = 0.0, 500.0 if seen["toxic"] else -500.0
        return model
    model.lam = _lambda(seen["mass"], max(1, seen["words"]))
    marked = stored(train.mapInArrow(_best(model), "label int, n long, scores array<double>"), "segments")
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    clean = marked.filter("label = 0 and n > 0").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-model.lam * top))).first()
    model.k = clean[0] / clean[1] if clean[0] else 1.0
    least = F.log(F.greatest(F.lit(1e-300), F.lit(model.k) * F.col("n")))
    evidence = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), model.lam * x - least))
    bins = marked.groupBy("label", F.least(F.lit(400), F.round(evidence * 4)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    model.slope, model.bias = _logistic([(r.bin / 4, r.label, r.n) for r in bins])
    return model


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Platt's curve by Newton steps on binned evidence; his smoothed targets keep it finite when classes separate."""
    x, y, n = (np.array([p[i] for p in points], float) for i in range(3))
    pos, neg = n[y > 0].sum(), n[y == 0].sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([0.0, math.log((pos + 1) / (neg + 1))])
    design = np.stack([x, np.ones_like(x)], 1)

    def loss(v):
        m = design @ v
        return (n * (np.logaddexp(0, m) - t * m)).sum() + 1e-3 * v[0] ** 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (n * (p - t)) + np.array([2e-3 * w[0], 0])
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([2e-3, 1e-6])
        step, size = np.linalg.solve(hess, grad), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(0.0, w[0])), float(w[1])


_SCORED = "struct<score: double, passages: array<struct<evidence: double, first: int, last: int>>>"


def scorer(model: Model):
    """Arrow UDF of UTF-8 text -> probability and significant passages (word positions)."""
    span = pa.struct([("evidence", pa.float64()), ("first", pa.int32()), ("last", pa.int32())])
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(span))])

    @F.arrow_udf(_SCORED)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = _Odds(model)
        for batch in texts:
            out = []
            for text in batch:
                _, found = passages(model, cache, text.as_py().decode())
                out.append({"score": model.probability(sum(x[0] for x in found)),
                            "passages": [{"evidence": e, "first": a, "last": b} for e, a, b in found]})
            yield pa.array(out, kind)

    return score


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``__toxic`` struct: score, predicted (1 if score >= threshold), passages.  Null text = empty text.

    Empty texts and texts without a significant passage take the probability of no evidence.  Repeated rows score alike.
    """
    got = docs.withColumn("__scored", scorer(model)(text_bytes(text_col)))
    return got.withColumn("__toxic", F.struct(
        F.col("__scored.score").alias("score"), (F.col("__scored.score") >= threshold).cast("int").alias("predicted"),
        F.col("__scored.passages").alias("passages"))).drop("__scored")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, passages``."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = score_documents(rows, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__toxic.score", "__toxic.predicted", "__toxic.passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    rows = packed(docs).select("__row", F.col(f"__row.`{text_col}`").alias("text"))
    return score_documents(rows, fit(docs, labels, id_col, text_col)).filter("__toxic.predicted = 0").select("__row.*")
