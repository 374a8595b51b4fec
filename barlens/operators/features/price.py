"""Price family: OHLCV pass-through, ratios, intraday returns, candle shape, multi-day returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import div, lag, pct, std

RETURN_PERIODS = (2, 3, 5, 10, 20)


def basic_price(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "date", "close", "open", "high", "low", "volume")


def price_ratios(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        div("high", "low").alias("high_low_ratio"),
        div("close", "open").alias("close_open_ratio"),
        div("high", "close").alias("high_close_ratio"),
        div("low", "close").alias("low_close_ratio"),
    )


def intraday_returns(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        pct("close", 1).alias("daily_return"),
        (div("open", lag("close", 1)) - 1).alias("overnight_return"),
        (div("close", "open") - 1).alias("intraday_return"),
    )


def candle_shape(df: DataFrame) -> DataFrame:
    c, o, h, l = (F.col(x) for x in ("close", "open", "high", "low"))
    return df.select(
        "*",
        div(h - l, c).alias("high_low_spread"),
        div(F.abs(c - o), c).alias("body_size"),
        div(h - F.greatest(o, c), c).alias("upper_shadow"),
        div(F.least(o, c) - l, c).alias("lower_shadow"),
    )


def multi_day_returns(df: DataFrame, periods=RETURN_PERIODS) -> DataFrame:
    """return_{p}d and un-annualised volatility_{p}d (sample sigma of daily_return over p rows)."""
    if "daily_return" not in df.columns:
        df = df.withColumn("daily_return", pct("close", 1))
    cols = []
    for p in periods:
        cols += [pct("close", p).alias(f"return_{p}d"), std("daily_return", p).alias(f"volatility_{p}d")]
    return df.select("*", *cols)


def price_family(bars: DataFrame) -> DataFrame:
    return multi_day_returns(candle_shape(intraday_returns(price_ratios(basic_price(bars)))))


def basic_features(bars: DataFrame) -> DataFrame:
    """The separate 13-column set used alongside labels."""
    from barlens.functions.series import sma

    c = F.col("close")
    return bars.select(
        "ticker", "date", "close", "open", "high", "low", "volume",
        div(F.col("high") - F.col("low"), c).alias("price_range"),
        div("open", "close").alias("open_close_ratio"),
        div("high", "close").alias("high_close_ratio"),
        div("low", "close").alias("low_close_ratio"),
        pct("close", 1).alias("return_1d"),
        pct("close", 5).alias("return_5d"),
        pct("close", 20).alias("return_20d"),
        div("volume", sma("volume", 20)).alias("volume_ratio"),
    )
