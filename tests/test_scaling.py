"""Steps that a query repeats or shuffles only once, and the same results as the plain forms, on rows of their own."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.operators import drift as dr
from driftwise.operators import evaluate as ev
from driftwise.operators import models as md
from driftwise.operators import retrieval as rt
from driftwise.operators import split as sp
from driftwise.operators import text as tx

DOCS = [(1, "red fox runs far"), (2, "red fox sleeps"), (2, "blue whale sings low and low"), (3, "a blue fox"), (4, ""), (None, "red red whale"), (5, None), (6, "Red FOX runs far")]
QUERIES = [(1, "red fox"), (2, "whale sings"), (3, "nothing known here")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grams(text):
    t = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])


def tfidf_expected(k):
    counts: dict = {}
    for d, text in DOCS:
        if text:
            counts.setdefault(d, Counter()).update(grams(text))
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(DOCS)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        length = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / length for t, v in w.items()}
    out = {}
    for q, text in QUERIES:
        qw = unit(grams(text))
        sims = [(round(sum(v * unit(counts[d]).get(t, 0) for t, v in qw.items()), 9), d) for d in counts if d is not None]
        for rank, (s, d) in enumerate(sorted([x for x in sims if x[0] > 0], key=lambda x: (-x[0], x[1]))[:k], 1):
            out[q, rank] = (d, s)
    return out


@pytest.mark.parametrize("limit", [1 << 26, 250])
def test_tfidf_with_and_without_rare_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(rt, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    top = rt.tfidf_topk(docs, "doc_id", queries, "item_id", "text", 3)
    got = {(r.item_id, r.rank): (r.doc_id, round(r.similarity, 9)) for r in top.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in tfidf_expected(3).items()}
    assert all(got[k][1] == pytest.approx(v[1], abs=1e-8) for k, v in tfidf_expected(3).items())
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, (term|item_id)|hashpartitioning\(item_id#\d+L?, doc_id", plan(top))


def test_tags_are_counted_without_shuffling_pairs(spark):
    docs = spark.createDataFrame([(d, t) for d, t in DOCS], "doc_id long, text string")
    dealt = rt.dealt_by_key(docs, "doc_id", "text")
    dt = dealt.select("doc_id", F.explode_outer(rt.tokens(F.col("text"))).alias("tag"), F.lit(2).alias("priority")).where("tag is not null")
    qt = spark.createDataFrame(QUERIES, "item_id long, text string").select("item_id", F.explode(rt.tokens(F.col("text"))).alias("tag"))
    top = rt.tag_overlap_topk(qt, "item_id", dt, "doc_id", "priority", 3)
    assert not re.search(r"hashpartitioning\((doc_id#\d+L?, tag|item_id#\d+L?, doc_id)", plan(top))
    assert {(r.item_id, r.doc_id, r.overlap) for r in top.collect()} == {(1, 1, 2), (1, 2, 2), (1, 6, 2), (2, 2, 2), (2, None, 1)}


def test_strip_and_windows_equal_python(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["", " ", "".join(spaces), "".join(spaces) + "a b" + "".join(spaces), "​x​", "x" * 900, "x" * 901, "é😀 " * 700, "a" + " " * 2000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert "substring" not in plan(df.select(tx.chunk_array(F.col("t"))))
    for r in df.select("t", tx.py_strip(F.col("t")).alias("s"), tx.chunk_array(F.col("t")).alias("a"), tx.chunk_array(F.col("t"), 7, 5).alias("b")).collect():
        assert r.s == r.t.strip()
        for got, size, step in ((r.a, 900, 800), (r.b, 7, 2)):
            starts = range(0, (0 if len(r.t) <= size else math.ceil((len(r.t) - size) / step)) * step + 1, step) if r.t else []
            cut = [(s, r.t[s:s + size].strip()) for s in starts]
            assert [(w.start, w.chunk) for w in got] == [w for w in cut if w[1]]


def test_knowledge_chunks_are_cut_once(spark, tmp_path):
    from driftwise.catalog import ops

    rows = [(1, "same words in a text of this length", "en", "web", 9), (2, "same words in a text of this length", "de", "web", 9), (3, "short", "en", None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = ops.knowledge_stats(spark, str(tmp_path))
    assert "posexplode" not in plan(out)
    assert {(r.category, r.total_chunks, r.active_chunks) for r in out.collect()} == {("en", 1, 1), ("de", 1, 0)}


def test_auc_of_groups_needs_no_second_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(s), int(y)) for g, s, y in zip(rng.integers(0, 3, 900), rng.integers(0, 40, 900) / 8, rng.integers(0, 2, 900))] + [(7, 1.0, 1), (None, 0.5, 0), (None, 0.7, 1), (0, None, 1), (0, float("nan"), 0)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    want = {}
    for g in {r[0] for r in rows} - {None}:
        own = [(s, y) for k, s, y in rows if k == g and s is not None and s == s]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        want[g] = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    for edges in (None, [], [1.0, 2.5], [9.0]):
        out = ev.roc_auc(df, "s", "y", ["g"], edges)
        assert {r.g: r.roc_auc for r in out.collect()} == pytest.approx(want)
        assert plan(out).split("== Initial Plan ==")[0].count("Scan ExistingRDD") == 1


def test_folds_in_waves_give_the_same_auc(spark, monkeypatch):
    from driftwise.operators.preparation import preparation

    rng = np.random.default_rng(4)
    rows = [(i, float(x), "ab"[i % 2], float(rng.random() < 1 / (1 + math.exp(-x))), i % 3) for i, x in enumerate(rng.standard_normal(240))]
    train = spark.createDataFrame(rows, "id long, x double, c string, label double, fold int")
    prep = preparation(["x"], ["c"])
    held: list[int] = []
    folds = md.prepared_folds
    monkeypatch.setattr(md, "prepared_folds", lambda *a: held.append(len(a[4])) or folds(*a))
    at_once = md.cross_validated_auc(train, prep, md.baseline_estimator(), [{}], "fold", 3)
    monkeypatch.setattr(md, "ROWS_AT_ONCE", 100)
    assert md.cross_validated_auc(train, prep, md.baseline_estimator(), [{}], "fold", 3) == (pytest.approx(at_once[0]), pytest.approx(at_once[1]))
    assert held == [3, 1, 1, 1]


def test_splits_read_a_written_first_cut(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 1)], "k long, y int")
    out = sp.three_way_split(df, "k", "y")
    assert "Scan parquet" in plan(out) and "ExistingRDD" not in plan(out)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 10, "cal": 8, "train": 33}


def test_drift_bins_parse_only_text(spark):
    df = spark.createDataFrame([(1, 0.1, "3"), (2, float("nan"), "x"), (None, 5e-324, "4"), (9, 1.5, None)], "a int, b double, c string")
    out = dr.binned_counts(df, df, ["a", "b", "c"], 4)
    assert "try_cast(cast(b" not in plan(out) and "cast(b#" not in plan(out).replace("try_cast", "")
    assert {(r.column_name, r.tot_ref) for r in out.collect()} == {("a", 3), ("b", 3), ("c", 2)}
