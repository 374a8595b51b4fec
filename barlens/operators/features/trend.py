"""Trend family: moving-average trend and position, slope strength, MA convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import div, lag, reuse, sma, std

TREND_PERIODS = (10, 20, 50)
SLOPE_PERIODS = (10, 20)


def ma_trend(df: DataFrame, periods=TREND_PERIODS) -> DataFrame:
    t = df.select("*", *[reuse(df, f"sma_{p}", sma("close", p)).alias(f"_ma{p}") for p in periods])
    cols = [div(F.col(f"_ma{p}") - lag(f"_ma{p}", 5), lag(f"_ma{p}", 5)).alias(f"ma_trend_{p}") for p in periods]
    return t.select("*", *cols).drop(*[f"_ma{p}" for p in periods])


def price_ma_position(df: DataFrame, periods=TREND_PERIODS) -> DataFrame:
    cols = []
    for p in periods:
        m = reuse(df, f"sma_{p}", sma("close", p))
        cols.append(div(F.col("close") - m, m).alias(f"price_ma_position_{p}"))
    return df.select("*", *cols)


def trend_slope(df: DataFrame, periods=SLOPE_PERIODS) -> DataFrame:
    cols = []
    for p in periods:
        slope = (F.col("close") - lag("close", p)) / F.lit(float(p))
        cols.append(div(slope, std("close", p)).alias(f"trend_strength_{p}"))
    return df.select("*", *cols)


def ma_convergence(df: DataFrame, periods=TREND_PERIODS) -> DataFrame:
    ps = sorted(periods)
    lo, hi = ps[0], ps[-1]
    def m(p):
        return reuse(df, f"sma_{p}", sma("close", p))

    cols = [div(m(lo) - m(hi), m(hi)).alias(f"ma_convergence_{lo}_{hi}")]
    if len(ps) >= 3:
        mid = ps[1]
        cols.append(div(m(mid) - m(hi), m(hi)).alias(f"ma_convergence_{mid}_{hi}"))
    return df.select("*", *cols)


def trend_family(df: DataFrame) -> DataFrame:
    for f in (ma_trend, price_ma_position, trend_slope, ma_convergence):
        df = f(df)
    return df
