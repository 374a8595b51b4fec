"""Newton fits of penalised logistic regression: MLlib's minimum in a few passes over the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from barlens.operators import logistic, models


def _rows(spark, n=1500, p=12):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p))
    x[:, 3], x[:, 4] = 0.0, 7.5  # columns that tell nothing
    y = (x[:, 0] + 3 * rng.normal(size=n) > 0).astype(float)
    return spark.createDataFrame([(float(a), Vectors.dense(b)) for a, b in zip(y, x, strict=True)], ["label", "features"]).repartition(4).cache()


@pytest.mark.parametrize("reg, share", [(1e-4, 0.5), (1e-3, 0.0), (0.02, 1.0)])
def test_the_minimum_is_that_of_mllib(spark, monkeypatch, reg, share):
    rows, passes, summed = _rows(spark), [], logistic._summed
    monkeypatch.setattr(logistic, "_summed", lambda *a: passes.append(1) or summed(*a))
    kw = dict(regParam=reg, elasticNetParam=share, standardization=False, maxIter=5000)
    want = LogisticRegression(tol=1e-12, **kw).fit(rows)
    got = logistic.NewtonLogisticRegression(tol=1e-6, **kw).fit(rows)
    assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-4)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-4)
    assert list(got.coefficients[3:5]) == [0.0, 0.0]
    assert got.getRegParam() == reg and len(passes) <= 15
    rows.unpersist()


def test_models_of_the_registry_are_fitted_in_few_passes(spark, monkeypatch):
    rows, passes, summed = _rows(spark), [], logistic._summed
    monkeypatch.setattr(logistic, "_summed", lambda *a: passes.append(1) or summed(*a))
    for name in ("logistic_regression", "elastic_net"):
        models.estimator(name, 12, 1500).fit(rows)
    assert 0 < len(passes) <= 30
    rows.unpersist()


def test_one_class_goes_to_mllib(spark):
    rows = spark.createDataFrame([(1.0, Vectors.dense([float(i), 1.0])) for i in range(20)], ["label", "features"])
    assert models.estimator("elastic_net", 2, 20).fit(rows).intercept == float("inf")


def test_the_quadratic_model_meets_its_conditions():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(160, 40))
    a[:, 5] = 2 * a[:, 7]  # collinear
    hess, grad, l1 = a.T @ a / 160, a.T @ rng.normal(size=160) / 160, np.full(40, 0.01)
    l1[0] = 0.0
    for at in (np.zeros(40), rng.normal(size=40) / 10):
        v = logistic.minimise(grad, hess, at, l1)
        slope, zero = grad + hess @ (v - at), v == 0
        assert zero.any() and np.all(abs(slope)[zero] <= l1[zero] + 1e-8)
        assert abs(slope + l1 * np.sign(v))[~zero].max() < 1e-8
