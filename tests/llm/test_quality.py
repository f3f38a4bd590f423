"""Compression classifier: held-out accuracy, sizes by brute force, too few labels, edges."""

import numpy as np
import zstandard

from driftwise.llm import quality
from driftwise.llm.common import table
from tests.conftest import MEDIUM
from tests.llm import edge


def test_held_out_accuracy(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.95
    assert {q for q, _ in held} == {0, 1}


def test_sizes_are_those_of_whole_texts():
    good, bad = [b"the quick brown fox %d" % i * 20 for i in range(300)], [b"$$$ %d ### " % i * 30 for i in range(300)]
    model = quality.Model(quality.dictionary(good, 4096), quality.dictionary(bad, 4096))
    text = b"the quick brown fox " * 500 + b"$$$ ### " * 300
    want = []
    for raw in (model.good, model.bad, None):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False,
                                     dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        want.append(sum(len(c.compress(text[i:i + quality.BLOCK])) for i in range(0, len(text), quality.BLOCK)))
    assert list(model.sizes(text)) == want and model.sizes(b"") == (0, 0, 0)


def test_logistic_finds_the_boundary():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.abs(quality.logistic(x, y) - [1, 2, -1]).max() < 0.2


def test_few_labels_and_edges(spark):
    docs = edge.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (6, 1), (7, 1), (8, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality.quality_scores(docs, one).collect()}) == 1
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] * 2, "doc_id long, quality int")
    got = quality.quality_scores(docs, both).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.quality_scores(edge.none(spark), both).collect() == []
