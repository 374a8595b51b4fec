"""Two-level recursion, blocks with a halo, Gram moments, distributed selection, model registry and stream state."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import closes, make_bars
from pyspark.sql import functions as F

from barlens.functions import series as S
from barlens.operators import models, quantiles, reports, select
from barlens.operators.features.engineer import engineer


def _walk(n, seed=5):
    rng = np.random.default_rng(seed)
    return 100 * np.cumprod(1 + rng.normal(0, 0.02, n)), rng.integers(1000, 5000, n).astype(float)


def test_ewm_over_three_levels_of_blocks(spark):
    c, v = _walk(300)
    c[[0, 1, 70, 71, 200]] = np.nan
    rows = spark.createDataFrame([("A", i, None if math.isnan(x) else float(x)) for i, x in enumerate(c)], "ticker string, date int, x double")
    for block in (2, 3, 5):
        got = S.with_ewm(rows, {"y": ("x", 0.2)}, block=block).orderBy("date").toPandas().y
        want = pd.Series(c).ewm(alpha=0.2, adjust=False, ignore_na=True).mean()
        assert (got.isna() == want.isna()).all() and np.allclose(got.dropna(), want.dropna(), rtol=1e-12)


@pytest.mark.parametrize("k", [1, 2, 7, 40, 90])
def test_running_extremes_equal_pandas(spark, k):
    c, _ = _walk(80, 9)
    c[[3, 50]] = np.nan
    rows = spark.createDataFrame([(t, i, None if math.isnan(x) else float(x)) for t in "AB" for i, x in enumerate(c)], "ticker string, date int, x double")
    got = S.with_extremes(rows, {"hi": ("max", "x", k), "lo": ("min", "x", k)}).where("ticker = 'B'").orderBy("date").toPandas()
    for name, want in (("hi", pd.Series(c).rolling(k).max()), ("lo", pd.Series(c).rolling(k).min())):
        assert (got[name].isna() == want.isna()).all() and np.allclose(got[name].dropna(), want.dropna())


def test_features_do_not_depend_on_blocks(spark):
    c, v = _walk(620)
    c2, v2 = _walk(40, 6)
    bars = make_bars(spark, closes(spark, "A", c, v) + closes(spark, "B", c2, v2))
    m, w = _walk(640, 7)
    bench = make_bars(spark, closes(spark, "M", m, w)).select("date", F.col("close").alias("bclose"), F.col("volume").alias("bvolume"))
    whole, cut = (engineer(bars, bench, block_rows=n).orderBy("ticker", "date").toPandas() for n in (4096, 30))
    assert list(whole.columns) == list(cut.columns) and len(whole) == len(cut) == 660
    for col in whole.columns[2:]:
        a, b = whole[col].astype(float), cut[col].astype(float)
        assert (a.isna() == b.isna()).all() and np.allclose(a.dropna(), b.dropna(), rtol=1e-9, atol=1e-12), col


def test_gram_correlations_with_nulls(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame(rng.normal(5, 2, (200, 5)), columns=list("abcde"))
    x["b"] = x["a"] * 2 + 1e6
    x["e"] = 3.0
    x = x.mask(rng.random(x.shape) < 0.2)
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in x.itertuples(index=False)], "a double, b double, c double, d double, e double").repartition(3)
    want = x.corr()
    for r in select.corr_matrix(df, list("abcde")).collect():
        w = want.loc[r.a, r.b]
        assert (r["corr"] is None) if "e" in (r.a, r.b) else abs(r["corr"] - w) < 1e-9
    kept = {r.feature: r.keep for r in select.corr_prune(df, list("abcde")).collect()}
    assert kept == {"a": True, "b": False, "c": True, "d": True, "e": True}


def test_order_statistics_narrow_down(spark):
    rng = np.random.default_rng(3)
    cols = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0, 2.0, 9.0], 750), "c": np.full(3000, np.nan), "d": np.where(rng.random(3000) < 0.5, np.nan, rng.random(3000))}
    pdf = pd.DataFrame(cols)
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double, d double").repartition(4)
    got = quantiles.quantiles(df, [0.0, 0.1, 0.5, 0.93, 1.0])
    for c in "abd":
        assert np.allclose(got[c], [pdf[c].quantile(q) for q in (0.0, 0.1, 0.5, 0.93, 1.0)])
    assert got["c"] == [None] * 5
    size, few = quantiles.order_statistics(df, lambda c, n: [n // 3], limit=2)  # sketched again inside, down to two values
    assert few[("a", 1000)] == sorted(cols["a"])[1000] and size["c"] == 0


def test_binned_mutual_information_keeps_ties_together(spark):
    rows = [(float(i // 50), float(i % 2), int(i // 50 > 1), None) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, outperforms int, c double")
    got = {r.feature: r.mutual_info for r in select.mutual_info_binned(df, ["a", "b", "c"]).collect()}
    assert abs(got["a"] - math.log(2)) < 1e-12 and abs(got["b"]) < 1e-12 and "c" not in got


def test_zero_first_close_is_null(spark):
    bars = make_bars(spark, closes(spark, "Z", [0.0, 1.0, 2.0]))
    assert reports.ticker_performance(bars, 1).first().total_return is None


def _labelled(spark, n=200):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.2, n) > 0).astype(int)
    cols = [f"f{k}" for k in range(6)]
    rows = [(f"T{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "ticker string, date date, close double, " + ", ".join(f"{c} double" for c in cols) + ", outperforms int"), cols


def test_rfe_keeps_what_matters_and_drops_one_a_refit(spark, monkeypatch):
    df, cols = _labelled(spark)
    seen = []
    slicer = models.VectorSlicer
    monkeypatch.setattr(models, "VectorSlicer", lambda **kw: seen.append(len(kw["indices"])) or slicer(**kw))
    kept = models.rfe(df, cols, keep=2, trees=10, depth=3)
    assert set(kept) == {"f0", "f1"} and seen == [6, 5, 4, 3]


def test_tune_covers_the_grid(spark):
    df, cols = _labelled(spark)
    cv = models.tune(df, cols, "logistic_regression", folds=2, parallelism=1)
    assert len(cv.avgMetrics) == 6 and max(cv.avgMetrics) > 0.9


def test_saved_models_are_listed_best_first(spark, tmp_path):
    df, cols = _labelled(spark)
    for name, feats, stocks in (("ridge", cols[2:], 3), ("elastic_net", cols, 3), ("ridge", cols[2:], 3)):
        m = models.fit(name, df, feats)
        models.save_model(m, str(tmp_path / f"{name}_{stocks}stocks_v1.model"), str(tmp_path / "registry"), name, models.evaluate(m, df, name), len(feats), 200, stocks)
    got = models.list_models(spark, str(tmp_path / "registry")).collect()
    assert [(r.model_name, r.is_best_model) for r in got] == [("elastic_net", True), ("ridge", False)]
    assert all(r.file_size_mb > 0 and r.training_date and r.auc is not None and r.training_samples == 200 for r in got) and got[0].auc > got[1].auc
    from barlens.operators import registry

    rows = models.list_models(spark, str(tmp_path / "registry"))
    assert [r.parsed_stocks for r in registry.registry_scan(rows).collect()] == [3, 3]
    assert registry.scaling_report(rows).first().best_model == "elastic_net"


def test_scores_beyond_the_training_range_are_clipped(spark):
    df, cols = _labelled(spark)
    m = models.fit("logistic_regression", df, cols)
    far = df.withColumn("f0", F.lit(1e9))
    bounds = models.feature_bounds(df, cols)
    free, held = (models.score_universe(m, far, cols, "lr", bounds=b).collect() for b in (None, bounds))
    assert {r.outperform_probability for r in free} == {1.0}
    assert all(0.0 < r.outperform_probability < 1.0 and r.features_clipped == 1 for r in held)


def _events(spark, path, rows):
    df = spark.createDataFrame([(i, t, i % 3, k, float(i), "") for i, t, k in rows], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.toPandas().assign(ts=lambda d: d.ts.astype("datetime64[us]")).to_parquet(path)


def test_stream_state_is_compacted_and_repeats_days_apart_land_once(spark, tmp_path):
    from barlens.streaming import bars as STR
    from barlens.session import scratch_path

    day = lambda d, h=0: dt.datetime(2024, 1, d, h, 5)
    src, name = tmp_path / "in", f"t-{tmp_path.name}-{id(tmp_path)}"
    src.mkdir()
    _events(spark, src / "events.parquet", [(1, day(1), "a"), (2, day(1, 3), "a"), (3, day(9), "b")])
    first = STR.stream_dedup(spark, str(src), f"d-{name}").collect()
    assert sorted(r.event_id for r in first) == [1, 2, 3]
    assert STR.stream_bars(spark, str(src), f"b-{name}").count() == 3
    _events(spark, src / "events-2.parquet", [(1, day(1), "a"), (4, day(1, 1), "a"), (5, day(10), "b")])  # a range of day 1 again, long after day 9
    again = STR.stream_dedup(spark, str(src), f"d-{name}").collect()
    assert sorted(r.event_id for r in again) == [1, 2, 3, 4, 5]
    STR.stream_bars(spark, str(src), f"b-{name}").count()
    out = scratch_path(spark, "streams", f"b-{name}")
    assert STR._numbers(spark, f"{out}/data") == [] and len(STR._numbers(spark, f"{out}/state")) == 1


@pytest.mark.parametrize("per_block", [1, 2, 256])
def test_return_correlations_do_not_depend_on_blocks(spark, per_block):
    rng = np.random.default_rng(8)
    price = {t: 100 * np.cumprod(1 + rng.normal(0, 0.02, 40)) for t in ("B", "A", "SPY", "C")}
    price["A"] = price["B"] * 3.0
    price["flat"] = np.full(40, 7.0)
    bench = 50 * np.cumprod(1 + rng.normal(0, 0.02, 40))
    rows = [r for t, v in price.items() for r in closes(spark, t, v) if (t, r[1]) != ("C", 11)]  # a date that one series lacks
    bars = make_bars(spark, rows).repartition(3)
    market = make_bars(spark, closes(spark, "M", bench)).select("date", "close")
    rows = reports.return_corr_matrix(bars, market, bench_name="SPY", per_block=per_block).collect()
    got = {(r.a, r.b): (r["corr"], r.edge) for r in rows}
    wide = pd.DataFrame({**price, "market": bench}).drop(index=11).pct_change().dropna()
    want = wide.corr()
    # the benchmark bears the name of a series here; it comes last, and the series keeps its own rows
    assert len(rows) == 15 and len(got) == 12 and ("A", "B") in got and got[("A", "B")] == (pytest.approx(1.0), True)
    for (a, b), (c, edge) in got.items():
        if "flat" in (a, b):
            assert c is None and edge is None
        elif b != "SPY" and a != "SPY":
            assert c == pytest.approx(want.loc[a, b]) and edge == (abs(want.loc[a, b]) >= 0.6)


def test_return_correlations_of_nothing(spark):
    assert reports.return_corr_matrix(make_bars(spark, []), make_bars(spark, []).select("date", "close")).collect() == []


def test_rows_without_a_benchmark_take_zero_before_scaling(spark):
    df, cols = _labelled(spark)
    scale = select.fit_scale(df, cols)
    lacking = df.drop("f5").withColumn("f4", F.when(F.col("ticker") != "T0", F.col("f4")))
    got = select.model_rows(lacking, cols, scale, ["ticker", "date"])
    assert got.columns == ["ticker", "date", *cols]
    mu, sd = scale["f5"]
    one = got.agg(F.min("f5").alias("lo"), F.max("f5").alias("hi"), F.stddev_pop("f0").alias("s"), F.count("f4").alias("n")).first()
    assert one.lo == one.hi == pytest.approx(-mu / sd) and one.s == pytest.approx(1.0) and one.n == 200
    middle = lacking.agg(F.percentile("f4", 0.5)).first()[0]
    assert got.where("ticker = 'T0'").first().f4 == pytest.approx((middle - scale["f4"][0]) / scale["f4"][1])


def test_scale_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (3.0, 2.0, None)], "a double, b double, c double")
    assert select.fit_scale(df, list("abc")) == {"a": (2.0, 1.0), "b": (2.0, 1.0), "c": (None, 1.0)}
    assert [tuple(r) for r in select.standardize(df, list("abc")).orderBy("a").collect()] == [(-1.0, 0.0, None), (1.0, 0.0, None)]
