"""Volatility family: return sigma, its rank inside a 2p window, ratio, realized vol, clustering."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import div, pct, rank_in_window, reuse, std

VOLATILITY_PERIODS = (5, 10, 20)
TRADING_DAYS = 252


def _ret(df: DataFrame) -> DataFrame:
    return df if "_ret" in df.columns else df.select("*", reuse(df, "daily_return", pct("close", 1)).alias("_ret"))


def volatility(df: DataFrame, periods=VOLATILITY_PERIODS) -> DataFrame:
    t = _ret(df)
    return t.select("*", *[std("_ret", p).alias(f"volatility_{p}") for p in periods]).drop("_ret")


def volatility_rank(df: DataFrame, periods=VOLATILITY_PERIODS) -> DataFrame:
    """volatility_rank_p = average-tie rank of volatility_p within the last 2p rows, / 2p."""
    t = df if all(f"volatility_{p}" in df.columns for p in periods) else volatility(df, periods)
    cols = [(rank_in_window(f"volatility_{p}", 2 * p) / F.lit(2.0 * p)).alias(f"volatility_rank_{p}") for p in periods]
    return t.select("*", *cols)


def vol_ratio(df: DataFrame, periods=VOLATILITY_PERIODS) -> DataFrame:
    lo, hi = min(periods), max(periods)
    t = df if all(f"volatility_{p}" in df.columns for p in (lo, hi)) else volatility(df, periods)
    return t.select("*", div(f"volatility_{lo}", f"volatility_{hi}").alias(f"vol_ratio_{lo}_{hi}"))


def realized_vol(df: DataFrame) -> DataFrame:
    t = _ret(df)
    return t.select("*", (F.lit(math.sqrt(TRADING_DAYS)) * reuse(t, "volatility_20", std("_ret", 20))).alias("realized_vol")).drop("_ret")


def vol_clustering(df: DataFrame) -> DataFrame:
    t = df if "volatility_20" in df.columns else volatility(df, (20,))
    return t.select("*", std("volatility_20", 5).alias("vol_clustering"))


def volatility_family(df: DataFrame) -> DataFrame:
    for f in (volatility, volatility_rank, vol_ratio, realized_vol, vol_clustering):
        df = f(df)
    return df
