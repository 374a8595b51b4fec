"""Technical indicators (SMA, EMA, RSI, Bollinger, MACD, ATR, volume SMA, OBV, stochastic, CCI, %R).

Recursive indicators (EMA, RSI, MACD, ATR) use the block-wise recursion of
``barlens.functions.series.with_ewm`` so they stay JVM window expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import (
    CUM, R, W, div, full, lag, reuse, roll, seen, sma, with_ema, with_ewm, with_extremes,
)

# Fixed indicator parameters (defaults of the feature configuration).
SMA_PERIODS = (5, 10, 20, 50)
EMA_PERIODS = (12, 26)
RSI_PERIOD = 14
BB_PERIOD, BB_STD = 20, 2
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
ATR_PERIOD = 14
VOLUME_SMA_PERIOD = 20
STOCH_WINDOW, STOCH_SMOOTH = 14, 3
CCI_WINDOW, CCI_CONSTANT = 20, 0.015
WILLIAMS_LBP = 14


def sma_features(df: DataFrame, periods=SMA_PERIODS) -> DataFrame:
    cols = []
    for p in periods:
        s = sma("close", p)
        cols += [s.alias(f"sma_{p}"), div("close", s).alias(f"close_sma_{p}_ratio")]
    return df.select("*", *cols)


def ema_features(df: DataFrame, periods=EMA_PERIODS) -> DataFrame:
    t = with_ema(df, {f"ema_{p}": ("close", p) for p in periods})
    cols = [c for p in periods for c in (F.col(f"ema_{p}"), div("close", f"ema_{p}").alias(f"close_ema_{p}_ratio"))]
    return t.select(*df.columns, *cols)


def rsi(df: DataFrame, n: int = RSI_PERIOD) -> DataFrame:
    d = F.col("close") - lag("close", 1)
    t = df.select(
        "*",
        F.when(d > 0, d).otherwise(F.lit(0.0)).alias("_up"),
        F.when(d < 0, -d).otherwise(F.lit(0.0)).alias("_dn"),
    )
    t = with_ewm(t, {"_eu": ("_up", 1.0 / n), "_ed": ("_dn", 1.0 / n)})
    up, dn = F.col("_eu"), F.col("_ed")
    val = F.when(dn == 0, F.lit(100.0)).otherwise(F.lit(100.0) - div(F.lit(100.0), F.lit(1.0) + div(up, dn)))
    return t.select("*", F.when(seen("_up") >= n, val).alias("rsi")).drop("_up", "_dn", "_eu", "_ed")


def bollinger(df: DataFrame, n: int = BB_PERIOD, k: float = BB_STD) -> DataFrame:
    t = df.select("*", reuse(df, f"sma_{n}", sma("close", n)).alias("bb_middle"), roll(F.stddev_pop, "close", n).alias("_sd"))
    u = F.col("bb_middle") + F.lit(float(k)) * F.col("_sd")
    lo = F.col("bb_middle") - F.lit(float(k)) * F.col("_sd")
    t = t.select("*", u.alias("bb_upper"), lo.alias("bb_lower")).drop("_sd")
    return t.select(
        "*",
        div(F.col("bb_upper") - F.col("bb_lower"), "bb_middle").alias("bb_width"),
        div(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")).alias("bb_position"),
    )


def macd(df: DataFrame, fast=MACD_FAST, slow=MACD_SLOW, sign=MACD_SIGNAL) -> DataFrame:
    t = with_ema(df, {f"_e{p}": ("close", p) for p in (fast, slow) if f"ema_{p}" not in df.columns})
    e = [F.col(f"ema_{p}" if f"ema_{p}" in df.columns else f"_e{p}") for p in (fast, slow)]
    t = t.select(*df.columns, (e[0] - e[1]).alias("macd"))
    t = with_ema(t, {"macd_signal": ("macd", sign)})
    return t.select("*", (F.col("macd") - F.col("macd_signal")).alias("macd_histogram"))


def true_range(skip_null: bool = True):
    """max(H-L, |H-C[t-1]|, |L-C[t-1]|); ``greatest`` skips the missing first-row terms."""
    pc = lag("close", 1)
    h, l = F.col("high"), F.col("low")
    tr = F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))
    return tr if skip_null else F.when(pc.isNotNull(), tr)


def atr(df: DataFrame, n: int = ATR_PERIOD) -> DataFrame:
    """Wilder ATR: seed = mean of the first n true ranges at row n, then (prev*(n-1)+TR)/n; 0 before."""
    rn = F.row_number().over(W())
    t = df.select("*", true_range().alias("_tr"), rn.alias("_rn"))
    seed = F.when(F.col("_rn") == n, F.avg("_tr").over(R(n))).when(F.col("_rn") > n, F.col("_tr"))
    t = t.select("*", seed.alias("_seed"))
    t = with_ewm(t, {"_ewm": ("_seed", 1.0 / n)})
    a = F.when(F.col("_rn") < n, F.lit(0.0)).otherwise(F.col("_ewm"))
    t = t.select("*", a.alias("atr")).drop("_tr", "_rn", "_seed", "_ewm")
    return t.select("*", div("atr", "close").alias("atr_ratio"))


def volume_sma(df: DataFrame, n: int = VOLUME_SMA_PERIOD) -> DataFrame:
    s = sma("volume", n)
    return df.select("*", s.alias("volume_sma"), div("volume", s).alias("volume_ratio"))


def obv(df: DataFrame) -> DataFrame:
    step = F.when(F.col("close") < lag("close", 1), -F.col("volume")).otherwise(F.col("volume"))
    return df.select("*", F.sum(step).over(CUM()).alias("obv"))


def stochastic(df: DataFrame, n: int = STOCH_WINDOW, smooth: int = STOCH_SMOOTH) -> DataFrame:
    t, lo, hi = _range(df, n)
    t = t.select(*df.columns, (F.lit(100.0) * div(F.col("close") - lo, hi - lo)).alias("stoch_k"))
    return t.select("*", sma("stoch_k", smooth).alias("stoch_d"))


def _range(df: DataFrame, n: int):
    """``df`` with the lowest low and the highest high of the last n rows, and these two columns."""
    t = with_extremes(df, {"_lowest": ("min", "low", n), "_highest": ("max", "high", n)})
    return t, F.col("_lowest"), F.col("_highest")


def cci(df: DataFrame, n: int = CCI_WINDOW, c: float = CCI_CONSTANT) -> DataFrame:
    t = df.select("*", ((F.col("high") + F.col("low") + F.col("close")) / 3.0).alias("_tp"))
    xs = F.collect_list("_tp").over(R(n))
    m = F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)
    mad = F.aggregate(F.transform(xs, lambda v: F.abs(v - m)), F.lit(0.0), lambda a, v: a + v) / F.size(xs)
    val = div(F.col("_tp") - sma("_tp", n), F.lit(c) * mad)
    return t.select("*", F.when(full("_tp", n), val).alias("cci")).drop("_tp")


def williams_r(df: DataFrame, n: int = WILLIAMS_LBP) -> DataFrame:
    t, lo, hi = _range(df, n)
    return t.select(*df.columns, (F.lit(-100.0) * div(hi - F.col("close"), hi - lo)).alias("williams_r"))


def technical_family(df: DataFrame) -> DataFrame:
    for f in (sma_features, ema_features, rsi, bollinger, macd, atr, volume_sma, obv, stochastic, cci, williams_r):
        df = f(df)
    return df
