"""Advanced family: MA crosses, volatility regimes, PVT, VWAP deviation, mean reversion, ADX, regime change."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import CUM, corr_k, div, lag, pct, quantile_k, reuse, rsum, sma, std

CROSS_PAIRS = ((5, 10), (10, 20), (20, 50))
REGIME_PERIODS = (20, 50)
REGIME_LOOKBACK, REGIME_QUANTILE = 252, 0.7
MEAN_REVERSION_PERIODS = (10, 20)
ADX_PERIODS = (14, 28)
TRADING_DAYS = 252


def momentum_cross(df: DataFrame, pairs=CROSS_PAIRS) -> DataFrame:
    cols = []
    for fast, slow in pairs:
        f, s = reuse(df, f"sma_{fast}", sma("close", fast)), reuse(df, f"sma_{slow}", sma("close", slow))
        cols += [
            F.coalesce(f > s, F.lit(False)).cast("int").alias(f"momentum_cross_{fast}_{slow}"),
            div(f - s, s).alias(f"momentum_strength_{fast}_{slow}"),
        ]
    return df.select("*", *cols)


def vol_regime(df: DataFrame, periods=REGIME_PERIODS, keep_existing: bool = True) -> DataFrame:
    """volatility_{w}d = annualised sigma; vol_regime_{w}d = 1 if above its trailing-252 70 % quantile.

    When a column of the same name already exists (the un-annualised price-family one), the existing
    column is kept (first definition wins) and the flag still uses the annualised value.
    """
    t = df.select("*", reuse(df, "daily_return", pct("close", 1)).alias("_r"))
    t = t.select("*", *[(F.lit(math.sqrt(TRADING_DAYS)) * std("_r", w)).alias(f"_av{w}") for w in periods])
    flags = [
        F.coalesce(F.col(f"_av{w}") > quantile_k(f"_av{w}", REGIME_QUANTILE, REGIME_LOOKBACK), F.lit(False))
        .cast("int").alias(f"vol_regime_{w}d")
        for w in periods
    ]
    t = t.select("*", *flags)
    for w in periods:
        name = f"volatility_{w}d"
        if name not in df.columns or not keep_existing:
            t = t.withColumn(name, F.col(f"_av{w}"))
    return t.drop("_r", *[f"_av{w}" for w in periods])


def pvt(df: DataFrame) -> DataFrame:
    pc = lag("close", 1)
    return df.select("*", F.sum(div(F.col("close") - pc, pc) * F.col("volume")).over(CUM()).alias("pvt"))


def vwap_deviation(df: DataFrame, n: int = 20) -> DataFrame:
    t = df.select("*", (F.col("close") * F.col("volume")).alias("_cv"))
    vwap = div(rsum("_cv", n), rsum("volume", n))
    return t.select("*", div(F.col("close") - vwap, vwap).alias("vwap_deviation")).drop("_cv")


def volume_momentum(df: DataFrame) -> DataFrame:
    return df.select("*", pct("volume", 5).alias("volume_momentum"))


def mean_reversion(df: DataFrame, periods=MEAN_REVERSION_PERIODS) -> DataFrame:
    cols = []
    for p in periods:
        s = reuse(df, f"sma_{p}", sma("close", p))
        cols += [div(F.col("close") - s, s).alias(f"mean_reversion_{p}"),
                 div(F.col("close") - s, std("close", p)).alias(f"price_zscore_{p}")]
    return df.select("*", *cols)


def adx(df: DataFrame, periods=ADX_PERIODS) -> DataFrame:
    """ADX with date-aligned directional movement (trend_strength_14 / _28).

    TR is NULL on the first row (no previous close).  +DM = up-move when it beats the down-move and is
    positive, else 0 (and symmetric for -DM).
    """
    from barlens.operators.features.technical import true_range

    up = F.col("high") - lag("high", 1)
    dn = lag("low", 1) - F.col("low")
    t = df.select(
        "*",
        true_range(skip_null=False).alias("_tr"),
        F.when(up > dn, F.greatest(up, F.lit(0.0))).otherwise(F.lit(0.0)).alias("_dmp"),
        F.when(dn > up, F.greatest(dn, F.lit(0.0))).otherwise(F.lit(0.0)).alias("_dmm"),
    )
    for p in periods:
        atr = sma("_tr", p)
        t = t.select(
            "*",
            (F.lit(100.0) * div(sma("_dmp", p), atr)).alias("_dip"),
            (F.lit(100.0) * div(sma("_dmm", p), atr)).alias("_dim"),
        )
        t = t.select("*", (F.lit(100.0) * div(F.abs(F.col("_dip") - F.col("_dim")), F.col("_dip") + F.col("_dim"))).alias("_dx"))
        t = t.select("*", sma("_dx", p).alias(f"trend_strength_{p}")).drop("_dip", "_dim", "_dx")
    return t.drop("_tr", "_dmp", "_dmm")


def vol_regime_change(df: DataFrame) -> DataFrame:
    t = df.select("*", reuse(df, "daily_return", pct("close", 1)).alias("_r"))
    return t.select("*", div(reuse(df, "volatility_10", std("_r", 10)), std("_r", 50)).alias("vol_regime_change")).drop("_r")


def market_correlation(df: DataFrame, n: int = 60, against: str | None = None) -> DataFrame:
    """Rolling correlation of daily returns with ``against`` (a return column), by default with the returns of the
    as-of benchmark (``bclose``).  Without a benchmark the returns meet themselves, as in the reference: 1.0 wherever the
    window has variance, NULL otherwise."""
    t = df.select("*", reuse(df, "daily_return", pct("close", 1)).alias("_r"))
    if against is None and "bclose" in df.columns:
        t = t.select("*", pct("bclose", 1).alias("_m"))
        against = "_m"
    return t.select("*", corr_k("_r", against or "_r", n).alias("market_correlation")).drop("_r", "_m")


def advanced_family(df: DataFrame) -> DataFrame:
    for f in (momentum_cross, vol_regime, pvt, vwap_deviation, volume_momentum, mean_reversion, adx,
              vol_regime_change, market_correlation):
        df = f(df)
    return df
