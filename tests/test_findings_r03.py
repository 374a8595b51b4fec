"""Fits whose jobs carry little: short lineage, tasks sized by the table, several fits at once; bars scanned once."""

import os
import random

import pytest
from pyspark.ml.tuning import CrossValidator

from barlens.operators import models
from barlens.sources import bars as SB


def _table(spark, n=240):
    rng = random.Random(3)
    rows = [(i, float(a), float(b), int(a + 0.5 * b + rng.gauss(0, 0.4) > 0)) for i in range(n) for a, b in [(rng.gauss(0, 1), rng.gauss(0, 1))]]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, outperforms int").repartition(24)


def test_a_linear_fit_runs_in_tasks_sized_by_its_table(spark):
    df = _table(spark)
    table = models.training_table(df, ["x1", "x2"])
    small = models.fit_matrix(table, ["label", "features"], models.LINEAR_CELLS)
    assert small.rdd.getNumPartitions() == 1 and small.count() == 240
    assert models.fit_matrix(table, ["label", "features"], 100).rdd.getNumPartitions() == 5  # 480 cells
    assert models.fit_matrix(table, ["label", "features"]).rdd.getNumPartitions() == 24
    empty = models.fit_matrix(table.where("false"), ["label", "features"], 100)
    assert empty.count() == 0
    got = models.fit("elastic_net", df, ["x1", "x2"]).stages[-1]
    want = models.estimator("elastic_net", 2, 240).fit(table)
    assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), rel=1e-3)


def test_folds_are_those_of_cross_validation(spark, monkeypatch):
    df = _table(spark)
    seen = {}

    def fit(self, matrix):
        seen["cv"], seen["matrix"] = self, matrix

    monkeypatch.setattr(CrossValidator, "fit", fit)
    models.tune(df, ["x1", "x2"], folds=3)
    rows = models.training_table(df, ["x1", "x2"]).select("label", "features")
    plain = CrossValidator(numFolds=3, seed=models.SEED)._kFold(rows)
    key = lambda t: sorted((r["label"], *r["features"]) for r in t.collect())
    for (_, held), (_, mine) in zip(plain, seen["cv"]._kFold(seen["matrix"]), strict=True):
        assert key(held) == key(mine)
    assert seen["matrix"].rdd.getNumPartitions() == 1


def test_fits_side_by_side_keep_order_and_failures(spark):
    out = models.fit_each([lambda: 1, lambda: 1 / 0, lambda: spark.range(3).count()])
    assert out[0] == 1 and isinstance(out[1], ZeroDivisionError) and out[2] == 3


def test_bars_are_not_scanned_again(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    b, m = SB.bars_and_market(spark, sf)
    for got, want in ((b, SB.bars(spark, sf)), (m, SB.market_bars(spark, sf))):
        assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
