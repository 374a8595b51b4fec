"""Momentum family: rate of change, momentum, acceleration, distance from moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import div, lag, pct, reuse, sma

ROC_PERIODS = (10, 20)
MOMENTUM_PERIODS = (5, 10, 20)
ACCELERATION_PERIODS = (5, 10)
TREND_PERIODS = (10, 20, 50)


def roc(df: DataFrame, periods=ROC_PERIODS) -> DataFrame:
    return df.select("*", *[(F.lit(100.0) * pct("close", p)).alias(f"roc_{p}") for p in periods])


def momentum(df: DataFrame, periods=MOMENTUM_PERIODS) -> DataFrame:
    return df.select("*", *[(div("close", lag("close", p)) - 1).alias(f"momentum_{p}") for p in periods])


def acceleration(df: DataFrame, periods=ACCELERATION_PERIODS) -> DataFrame:
    t = df.select("*", *[pct("close", p).alias(f"_r{p}") for p in periods])
    t = t.select("*", *[(F.col(f"_r{p}") - lag(f"_r{p}", p)).alias(f"acceleration_{p}") for p in periods])
    return t.drop(*[f"_r{p}" for p in periods])


def rs_sma(df: DataFrame, periods=TREND_PERIODS) -> DataFrame:
    cols = []
    for p in periods:
        s = reuse(df, f"sma_{p}", sma("close", p))
        cols.append(div(F.col("close") - s, s).alias(f"rs_sma_{p}"))
    return df.select("*", *cols)


def momentum_family(df: DataFrame) -> DataFrame:
    for f in (roc, momentum, acceleration, rs_sma):
        df = f(df)
    return df
