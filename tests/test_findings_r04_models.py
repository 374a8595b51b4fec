"""Training per universe size: every model, saved and listed."""

import datetime as dt
import random

import pytest

from barlens.operators import models
from barlens.plans import pipeline_queries as P


@pytest.fixture
def small(spark, monkeypatch):
    """Seven series of 40 labelled rows instead of the tables, and small trees and networks."""
    rng = random.Random(8)
    rows = []
    for t in range(7):
        for i in range(40):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((f"T{t}", dt.date(2024, 1, 1) + dt.timedelta(days=i), a, b, int(a + rng.gauss(0, 0.5) > 0), "train" if i < 30 else "test"))
    frame = spark.createDataFrame(rows, "ticker string, date date, f0 double, f1 double, outperforms int, split string")
    monkeypatch.setattr(P, "training_frame", lambda spark, sf: (frame, ["f0", "f1"]))
    monkeypatch.setattr(P.SB, "universe", lambda spark, sf, ticker: spark.createDataFrame([(i + 1, f"T{i}") for i in range(7)], "ordinal int, ticker string"))
    for name, value in (("RF_TREES", 3), ("RF_DEPTH", 3), ("GBT_ITERS", 2), ("GBT_DEPTH", 2), ("MLP_LAYERS", (3,))):
        monkeypatch.setattr(models, name, value)


def test_every_model_is_trained_and_saved_at_every_size(spark, small):
    got = P.saved_models(spark, "", sizes=(3, 7)).collect()
    assert {(r["model_name"], r["stocks_count"]) for r in got} == {(m, n) for m in models.MODEL_NAMES for n in (3, 7)} and len(got) == 14
    assert all(r["training_samples"] == 30 * r["stocks_count"] and r["auc"] > 0.5 and r["file_size_mb"] > 0 for r in got)
    assert [r["is_best_model"] for r in got] == [True] + [False] * 13


def test_universe_sizes_reach_the_whole_universe(spark, small):
    assert [P._scaling_sizes(n) for n in (0, 1, 2, 6, 7, 150)] == [[], [1], [1, 2], [2, 4, 6], [3, 5, 7], [50, 100, 150]]
    got = {r["stocks_count"]: r for r in P.RG.scaling_report(P.saved_models(spark, "", names=("ridge", "elastic_net"))).collect()}
    assert {n: r["training_samples"] for n, r in got.items()} == {3: 90, 5: 150, 7: 210}


def test_the_scaling_report_compares_every_model(spark, small, monkeypatch):
    seen, real = [], P.RG.scaling_report
    monkeypatch.setattr(P, "_scaling_sizes", lambda series: [series])
    monkeypatch.setattr(P.RG, "scaling_report", lambda reg: seen.append(reg.count()) or real(reg))
    assert [(r["stocks_count"], r["training_samples"]) for r in P.train_scaling(spark, "").collect()] == [(7, 210)] and seen == [7]
