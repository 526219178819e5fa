"""TreeSHAP against exact Shapley values by subset enumeration, and additivity on the leg model."""

import itertools
import math
import tempfile

import numpy as np

from contrail.operators import shap as SH


def _cond_value(t, x, subset, node=0):
    """E[f(x) | x_S] under the tree's cover distribution (path-dependent expectation)."""
    if t.left[node] < 0:
        return t.value[node]
    f = t.feature[node]
    l, r = t.left[node], t.right[node]
    if f in subset:
        goes_left = (x[f] in t.categories[node]) if t.categories[node] is not None else (x[f] <= t.threshold[node])
        return _cond_value(t, x, subset, l if goes_left else r)
    c = t.cover[l] + t.cover[r]
    return (t.cover[l] * _cond_value(t, x, subset, l) + t.cover[r] * _cond_value(t, x, subset, r)) / c


def _brute(t, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(len(others) + 1):
            for s in itertools.combinations(others, k):
                wgt = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[i] += wgt * (_cond_value(t, x, set(s) | {i}) - _cond_value(t, x, set(s)))
    return phi


def test_tree_shap_equals_subset_enumeration(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    rnd = np.random.default_rng(0)
    n = 400
    X = np.column_stack([rnd.integers(0, 3, n), rnd.normal(size=n), rnd.normal(size=n), rnd.integers(0, 2, n)]).astype(float)
    y = ((X[:, 1] + 0.8 * X[:, 0] - X[:, 2] * X[:, 3] + rnd.normal(scale=0.5, size=n)) > 0.5).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(v),) for r, v in zip(X, y)], "a double, b double, c double, d double, y double")
    va = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features")
    model = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(va.transform(df))
    trees = SH.ensemble_trees(spark, model, tempfile.mkdtemp(prefix="contrail-gbt-"))
    sample = X[:25]
    phi, base = SH.ensemble_shap(sample, trees, 4)
    for r in range(len(sample)):
        want = 2 * sum(t.weight * _brute(t, sample[r], 4) for t in trees)
        assert np.max(np.abs(phi[r] - want)) < 1e-9
    margins = [r.rawPrediction[1] for r in model.transform(va.transform(df)).limit(25).collect()]
    assert np.max(np.abs(phi.sum(1) + base - 2 * np.array(margins))) < 1e-9


def test_shap_additivity_on_leg_model(spark):
    import __spark_entry__ as E
    r = E.queries()["shap_additivity"](spark, "/root/testdata/sf0.01").first()
    assert r.rows > 0 and r.max_error < 1e-9
