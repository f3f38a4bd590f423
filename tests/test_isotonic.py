"""Block-wise isotonic fit against Spark ML's whole fit, with ties, long violations and rising runs."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from driftwise.operators.isotonic import apply_isotonic, fit_isotonic


def cases():
    rng = np.random.default_rng(4)
    n = 700
    noisy = rng.random(n)
    return {
        "ties": (np.round(rng.random(n), 2), rng.integers(0, 2, n)),
        "noisy": (noisy, (rng.random(n) < noisy).astype(int)),
        "falling": (np.arange(n) / n, (np.arange(n) < n // 2).astype(int)),
        "rising": (np.arange(n) / n, np.arange(n)),
        "one score": (np.full(n, 0.5), rng.integers(0, 2, n)),
    }


@pytest.mark.parametrize("name", cases())
def test_equals_whole_fit(spark, name):
    x, y = cases()[name]
    cal = spark.createDataFrame(list(zip(x.tolist(), y.astype(float).tolist())), "p double, y double").repartition(5).cache()
    probe = spark.createDataFrame([(float(v), "k", i) for i, v in enumerate(np.r_[-1, 2, np.linspace(0, 1, 311), x[:50], x[:50]])], "p double, lo string, i int")
    whole = IsotonicRegression(featuresCol="f", labelCol="y").fit(VectorAssembler(inputCols=["p"], outputCol="f").transform(cal))
    want = {r.i: r.prediction for r in whole.transform(VectorAssembler(inputCols=["p"], outputCol="f").transform(probe)).collect()}
    pools = fit_isotonic(cal, "p", "y", block_rows=40)
    fit = pools.orderBy("lo").collect()
    assert all(a.hi < b.lo and a.value < b.value for a, b in zip(fit, fit[1:]))
    got = apply_isotonic(probe, pools, "p", "fit", block_rows=40)
    assert got.columns == ["p", "lo", "i", "fit"]
    found = {r.i: r.fit for r in got.collect()}
    assert found.keys() == want.keys()
    assert max(abs(found[i] - want[i]) for i in want) < 1e-9


def test_edges(spark):
    cal = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (0.2, None), (0.4, 0.0), (0.6, 1.0)], "p double, y double")
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (9.0,), (9.0,)], "p double")
    got = apply_isotonic(rows, fit_isotonic(cal, "p", "y"), "p", "p")
    assert sorted((r.p for r in got.collect()), key=str) == [0.5, 1.0, 1.0, None, None]
    empty = fit_isotonic(cal.limit(0), "p", "y")
    assert empty.count() == 0
    assert apply_isotonic(rows, empty, "p", "fit").filter(F.col("fit").isNull()).count() == 5
    assert apply_isotonic(rows.limit(0), fit_isotonic(cal, "p", "y"), "p", "fit").count() == 0
