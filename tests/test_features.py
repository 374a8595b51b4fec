"""Rolling-feature semantics against pandas (the reference's engine) on small series."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import closes, make_bars

from barlens.functions import series as S
from barlens.operators.features import momentum, price, technical, volatility, volume


def _series(n=60, seed=3):
    rng = np.random.default_rng(seed)
    c = 100 * np.cumprod(1 + rng.normal(0, 0.02, n))
    v = rng.integers(1000, 5000, n).astype(float)
    return c, v


def _pdf(df, cols):
    return df.orderBy("ticker", "date").select(*cols).toPandas()


def _close(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all(), (a, b)
    m = ~np.isnan(a)
    assert np.allclose(a[m], b[m], rtol=tol, atol=tol)


def test_rolling_mean_std_min_periods_match_pandas(spark):
    c, v = _series()
    df = make_bars(spark, closes(spark, "A", c, v))
    out = _pdf(df.select("ticker", "date", S.sma("close", 10).alias("m"), S.std("close", 10).alias("s")), ["m", "s"])
    s = pd.Series(c)
    _close(out.m, s.rolling(10).mean())
    _close(out.s, s.rolling(10).std())


def test_pct_change_and_multi_day_returns(spark):
    c, v = _series()
    out = _pdf(price.multi_day_returns(make_bars(spark, closes(spark, "A", c, v))), ["return_5d", "volatility_5d"])
    s = pd.Series(c)
    _close(out.return_5d, s.pct_change(5))
    _close(out.volatility_5d, s.pct_change().rolling(5).std())


def test_ema_fold_equals_pandas_ewm(spark):
    c, v = _series(300)
    out = _pdf(technical.ema_features(make_bars(spark, closes(spark, "A", c, v))), ["ema_12", "ema_26"])
    s = pd.Series(c)
    _close(out.ema_12, s.ewm(span=12, adjust=False, min_periods=12).mean(), 1e-12)
    _close(out.ema_26, s.ewm(span=26, adjust=False, min_periods=26).mean(), 1e-12)


def test_rsi_wilder_and_rising_series_is_100(spark):
    c, v = _series(80)
    out = _pdf(technical.rsi(make_bars(spark, closes(spark, "A", c, v))), ["rsi"])
    d = pd.Series(c).diff()
    up, dn = d.where(d > 0, 0.0), -d.where(d < 0, 0.0)
    eu = up.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    ed = dn.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    ref = pd.Series(np.where(ed == 0, 100, 100 - 100 / (1 + eu / ed)))
    ref[eu.isna()] = np.nan
    _close(out.rsi, ref, 1e-10)
    rising = _pdf(technical.rsi(make_bars(spark, closes(spark, "R", list(range(1, 31))))), ["rsi"])
    assert rising.rsi[:13].isna().all() and (rising.rsi[13:] == 100.0).all()


def test_obv_tie_adds_volume(spark):
    df = make_bars(spark, closes(spark, "A", [10, 10, 9, 11], [100, 200, 300, 400]))
    assert list(_pdf(technical.obv(df), ["obv"]).obv) == [100, 300, 0, 400]


def test_bollinger_uses_population_sigma(spark):
    c, v = _series()
    out = _pdf(technical.bollinger(make_bars(spark, closes(spark, "A", c, v))), ["bb_upper"])
    s = pd.Series(c)
    _close(out.bb_upper, s.rolling(20).mean() + 2 * s.rolling(20).std(ddof=0))


def test_volatility_rank_average_ties(spark):
    c, v = _series(40)
    df = volatility.volatility_rank(make_bars(spark, closes(spark, "A", c, v)), (5,))
    out = _pdf(df, ["volatility_5", "volatility_rank_5"])
    ref = out.volatility_5.rolling(10).rank() / 10
    _close(out.volatility_rank_5, ref)
    # ties: constant values rank in the middle
    t = spark.createDataFrame([("A", i, 1.0) for i in range(6)], "ticker string, date int, x double")
    r = t.select(S.rank_in_window("x", 3).alias("r")).toPandas().r.tolist()
    assert r[:2] == [None, None] or all(math.isnan(x) for x in r[:2])
    assert r[2:] == [2.0, 2.0, 2.0, 2.0]


def test_constant_close_gives_null_corr_and_zscore_without_error(spark):
    from barlens.operators.features.advanced import mean_reversion

    df = make_bars(spark, closes(spark, "A", [5.0] * 25))
    out = _pdf(mean_reversion(volume.price_volume_corr(df)), ["price_zscore_20", "price_volume_corr_5"])
    assert out.price_zscore_20.isna().all()
    assert out.price_volume_corr_5.isna().all()


def test_short_and_single_row_tickers(spark):
    df = make_bars(spark, closes(spark, "S", [1.0, 2.0, 3.0]) + closes(spark, "O", [7.0]))
    out = _pdf(momentum.rs_sma(df, (10,)), ["ticker", "rs_sma_10"])
    assert out.rs_sma_10.isna().all()


def test_nvi_moves_only_on_lower_volume(spark):
    df = make_bars(spark, closes(spark, "A", [10, 11, 12, 6], [100, 50, 80, 40]))
    assert _pdf(volume.nvi(df), ["negative_volume_index"]).negative_volume_index.tolist() == pytest.approx([1000, 1100, 1100, 550])


def test_rsi_of_a_long_flat_stretch_keeps_its_last_value(spark):
    from barlens.operators.features.technical import rsi

    import math

    moving = [100.0 + 5.0 * math.sin(i * 1.7) + 0.1 * i for i in range(40)]
    out = rsi(make_bars(spark, closes(spark, "A", moving + [moving[-1]] * 700))).orderBy("date").toPandas()["rsi"].tolist()
    up = dn = 0.0
    values = moving + [moving[-1]] * 700
    want = []
    for i, v in enumerate(values):
        d = v - values[i - 1] if i else 0.0
        u, w = max(d, 0.0), max(-d, 0.0)
        up, dn = (u, w) if not i else (u / 14 + up * 13 / 14, w / 14 + dn * 13 / 14)
        want.append(100.0 if dn == 0 else 100.0 - 100.0 / (1.0 + up / dn))
    assert all(abs(a - b) < 1e-6 for a, b in zip(out[13:], want[13:]))
    assert abs(out[-1] - out[39]) < 1e-6


def test_ewm_skips_nulls_and_crosses_blocks(spark):
    from pyspark.sql import functions as F

    from barlens.functions.series import with_ewm

    n = 130
    df = spark.range(n).select(F.lit("A").alias("ticker"), F.col("id").alias("date"),
                               F.when((F.col("id") > 2) & (F.col("id") % 7 != 0), F.sin(F.col("id").cast("double"))).alias("x"))
    got = [r.y for r in with_ewm(df, {"y": ("x", 0.2)}, block=16).orderBy("date").collect()]
    acc, want = None, []
    for r in df.orderBy("date").collect():
        if r.x is not None:
            acc = r.x if acc is None else 0.2 * r.x + 0.8 * acc
        want.append(acc)
    assert all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(got, want))
