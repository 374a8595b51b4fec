"""Volume family: change, moving averages, volume-price trend, negative volume index, price/volume corr."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import CUM, corr_k, div, lag, pct, reuse, sma

VOLUME_MA_PERIODS = (5, 10, 20, 50)
PV_CORR_PERIODS = (5, 10, 20)
NVI_START = 1000.0


def volume_change(df: DataFrame) -> DataFrame:
    return df.select("*", pct("volume", 1).alias("volume_change"))


def volume_ma(df: DataFrame, periods=VOLUME_MA_PERIODS) -> DataFrame:
    cols = []
    for p in periods:
        m = reuse(df, "volume_sma", sma("volume", p)) if p == 20 else sma("volume", p)
        cols += [m.alias(f"volume_ma_{p}"), div("volume", m).alias(f"volume_ratio_{p}")]
    return df.select("*", *cols)


def vpt(df: DataFrame) -> DataFrame:
    """Volume-price trend: running sum of volume * daily return."""
    return df.select("*", F.sum(F.col("volume") * pct("close", 1)).over(CUM()).alias("volume_price_trend"))


def nvi(df: DataFrame) -> DataFrame:
    """Negative volume index: start at 1000, move with the price only on lower-volume bars."""
    step = F.when(F.col("volume") < lag("volume", 1), F.lit(1.0) + pct("close", 1)).otherwise(F.lit(1.0))
    t = df.select("*", step.alias("_nvi_step"))
    return t.select("*", (F.lit(NVI_START) * F.product("_nvi_step").over(CUM())).alias("negative_volume_index")).drop("_nvi_step")


def price_volume_corr(df: DataFrame, periods=PV_CORR_PERIODS) -> DataFrame:
    t = df.select("*", reuse(df, "daily_return", pct("close", 1)).alias("_pc"),
                  reuse(df, "volume_change", pct("volume", 1)).alias("_vc"))
    return t.select("*", *[corr_k("_pc", "_vc", p).alias(f"price_volume_corr_{p}") for p in periods]).drop("_pc", "_vc")


def volume_family(df: DataFrame) -> DataFrame:
    for f in (volume_change, volume_ma, vpt, nvi, price_volume_corr):
        df = f(df)
    return df
