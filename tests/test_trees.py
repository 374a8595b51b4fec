"""The forest of elimination over binned rows: MLlib's importances, in one pass over the rows a level."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from barlens.operators import models, trees


def _rows(spark, n=900, p=9, parts=5):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, p)).round(2)
    x[:, 2], x[:, 3] = 0.0, np.arange(n) % 3  # one value; three values
    x[rng.random(n) < 0.4, 4] = 0.0
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 5] + 0.3 * rng.normal(size=n) > 0).astype(float)
    return spark.createDataFrame([(float(a), Vectors.dense(b)) for a, b in zip(y, x, strict=True)], ["label", "features"]).repartition(parts).cache()


@pytest.mark.parametrize("cells", [700, 4_000_000])
def test_forest_importances_are_those_of_mllib(spark, monkeypatch, cells):
    monkeypatch.setattr(trees, "TREE_CELLS", cells)
    rows = _rows(spark, n=1500)
    used = [0, 1, 2, 4, 5, 6, 8]
    with trees.binned(rows, 1, 42) as b:  # a lone tree tries every feature; with every row once it is MLlib's
        b.blocks = b.blocks.map(lambda r: (r[0], r[1], np.ones_like(r[2])))
        lone = trees.forest_importances(b, list(range(9)), 1, 5, 42)
    want = RandomForestClassifier(numTrees=1, maxDepth=5, seed=42, bootstrap=False).fit(rows).featureImportances.toArray()
    assert lone == pytest.approx(want, abs=1e-9)
    with trees.binned(rows, 60, 42) as b:
        many = trees.forest_importances(b, used, 60, 4, 42)
    sliced = models.VectorSlicer(inputCol="features", outputCol="slice", indices=used).transform(rows)
    want = RandomForestClassifier(featuresCol="slice", numTrees=60, maxDepth=4, seed=42).fit(sliced).featureImportances.toArray()
    assert many == pytest.approx(want, abs=0.06) and many[2] == 0.0 and many.sum() == pytest.approx(1.0)
    rows.unpersist()


def test_elimination_bins_its_rows_once(spark, monkeypatch):
    calls, points = [], trees.split_points
    monkeypatch.setattr(trees, "split_points", lambda *a: calls.append(1) or points(*a))
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: 1 / 0)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(*map(float, r), int(r[3] > 0)) for r in x], ", ".join(f"f{k} double" for k in range(5)) + ", outperforms int")
    assert "f3" in models.rfe(df, [f"f{k}" for k in range(5)], keep=2, trees=8, depth=2) and calls == [1]
    for bad in (df.where("false"), df.selectExpr("* except (outperforms)", "if(f0 > 1, null, outperforms) AS outperforms"),
                df.selectExpr("* except (f0)", "if(f0 > 1, double('nan'), f0) AS f0")):
        with pytest.raises(Exception, match="a forest needs"):
            models.rfe(bad, [f"f{k}" for k in range(5)], keep=2, trees=8, depth=2)
