"""Relative-to-benchmark family.

Input: bars carrying the as-of benchmark columns ``bclose``/``bvolume`` (``joins.asof_benchmark``).
``s`` and ``b`` are the daily returns of the stock and of the aligned benchmark on the stock's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import corr_k, cov_k, div, lag, pct, quantile_k, reuse, rsum, sma, std, var_k

EXCESS_PERIODS = (5, 10, 20, 60)
REL_VOL_PERIODS = (20, 60)
BETA_PERIODS = (60, 120, 252)
CORR_PERIODS = (30, 60, 120)
STRENGTH_PERIODS = (20, 50)
SPIKE_PERIODS = (5, 20, 60)
VW_CORR_PERIODS = (20, 60)
HIGH_VOL_PERIODS = (20, 60)
HIGH_VOL_QUANTILE = 0.8
REL_MOMENTUM_PERIODS = (10, 20, 50)
TRACKING_PERIODS = (30, 60)
INFO_PERIODS = (60, 120)
VAR_EXPLAINED_PERIODS = (30, 90)
WEIGHT_LOOKBACK = 252


def returns(df: DataFrame) -> DataFrame:
    """Adds ``_s``, ``_b`` (daily returns) and ``_ex`` = s - b."""
    if "_s" in df.columns:
        return df
    t = df.select("*", reuse(df, "daily_return", pct("close", 1)).alias("_s"), pct("bclose", 1).alias("_b"))
    return t.select("*", (F.col("_s") - F.col("_b")).alias("_ex"))


def _done(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def index_ratio(df: DataFrame) -> DataFrame:
    t = df.select("*", div("close", "bclose").alias("stock_index_ratio"))
    return t.select("*", pct("stock_index_ratio", 1).alias("stock_index_ratio_change"))


def excess_return(df: DataFrame, periods=EXCESS_PERIODS) -> DataFrame:
    t = returns(df)
    cols = [F.col("_ex").alias("excess_return_1d")]
    for p in periods:
        sp, bp = pct("close", p), pct("bclose", p)
        cols += [(sp - bp).alias(f"excess_return_{p}d"), (div(sp, bp) - 1).alias(f"relative_return_{p}d")]
    return t.select("*", *cols)


def relative_volatility(df: DataFrame, periods=REL_VOL_PERIODS) -> DataFrame:
    t = returns(df)
    return t.select("*", *[div(std("_s", p), std("_b", p)).alias(f"relative_volatility_{p}d") for p in periods])


def rolling_beta(df: DataFrame, periods=BETA_PERIODS) -> DataFrame:
    t = returns(df)
    return t.select("*", *[div(cov_k("_s", "_b", p), var_k("_b", p)).alias(f"beta_{p}d") for p in periods])


def rolling_corr(df: DataFrame, periods=CORR_PERIODS) -> DataFrame:
    t = returns(df)
    return t.select("*", *[corr_k("_s", "_b", p).alias(f"correlation_{p}d") for p in periods])


def relative_strength(df: DataFrame, periods=STRENGTH_PERIODS) -> DataFrame:
    """relative_strength_{p}d and relative_ma_{p}d: (C/sma C)/(B/sma B) -- two names, one value."""
    cols = []
    for p in periods:
        v = div(div("close", reuse(df, f"sma_{p}", sma("close", p))), div("bclose", sma("bclose", p)))
        cols += [v.alias(f"relative_strength_{p}d"), v.alias(f"relative_ma_{p}d")]
    return df.select("*", *cols)


def volume_vs_index(df: DataFrame) -> DataFrame:
    return df.select("*", div("volume", "bvolume").alias("volume_ratio_vs_index"))


def index_weight(df: DataFrame, n: int = WEIGHT_LOOKBACK) -> DataFrame:
    """rho = 252-row mean of C/B; weight = rho / 252-row sum of rho (needs >= 2n-1 rows)."""
    t = df.select("*", div("close", "bclose").alias("_pr"))
    t = t.select("*", sma("_pr", n).alias("_rho"))
    t = t.select("*", div("_rho", rsum("_rho", n)).alias("estimated_index_weight"))
    return t.select("*", (F.col("volume") * F.col("estimated_index_weight")).alias("weight_adjusted_volume")).drop("_pr", "_rho")


def volume_participation(df: DataFrame) -> DataFrame:
    sp = div("volume", sma("volume", 20))
    ip = div("bvolume", sma("bvolume", 20))
    t = df.select("*", sp.alias("_sp"), ip.alias("_ip"))
    return t.select(
        "*",
        div("_sp", "_ip").alias("volume_participation_ratio"),
        F.coalesce(F.col("_sp") > F.col("_ip"), F.lit(False)).cast("int").alias("volume_leadership"),
    ).drop("_sp", "_ip")


def volume_spike(df: DataFrame, periods=SPIKE_PERIODS) -> DataFrame:
    t = df
    for p in periods:
        zs = div(F.col("volume") - sma("volume", p), std("volume", p))
        zb = div(F.col("bvolume") - sma("bvolume", p), std("bvolume", p))
        t = t.select("*", zs.alias("_zs"), zb.alias("_zb"))
        t = t.select(
            "*",
            corr_k("_zs", "_zb", p).alias(f"volume_spike_correlation_{p}d"),
            (F.col("_zs") - F.col("_zb")).alias(f"volume_leadership_strength_{p}d"),
        ).drop("_zs", "_zb")
    return t


def vw_excess_return(df: DataFrame) -> DataFrame:
    t = returns(df)
    v = F.col("_s") * div("volume", sma("volume", 20)) - F.col("_b") * div("bvolume", sma("bvolume", 20))
    return t.select("*", v.alias("volume_weighted_excess_return"))


def vw_correlation(df: DataFrame, periods=VW_CORR_PERIODS) -> DataFrame:
    t = returns(df)
    for p in periods:
        r = div("volume", sma("volume", p))
        t = t.select("*", r.alias("_vr"))
        # clip keeps a missing ratio missing (greatest/least alone would turn NULL into the bound)
        w = F.when(F.col("_vr").isNotNull(), F.least(F.greatest(F.col("_vr"), F.lit(0.0)), F.lit(3.0)))
        t = t.select("*", (F.col("_s") * w).alias("_sw")).drop("_vr")
        t = t.select("*", corr_k("_sw", "_b", p).alias(f"volume_weighted_correlation_{p}d")).drop("_sw")
    return t


def high_volume_corr(df: DataFrame, periods=HIGH_VOL_PERIODS) -> DataFrame:
    """Rolling corr(s, b) over the high-volume rows only (volume above its trailing p-row 80 %
    quantile), reported on those rows and NULL elsewhere.  The filtered sub-series is a window
    partitioned by (ticker, mask), so the filter-then-reindex needs no join."""
    t = returns(df)
    for p in periods:
        m = F.coalesce(F.col("volume") > quantile_k("volume", HIGH_VOL_QUANTILE, p), F.lit(False))
        t = t.select("*", m.alias("_m"))
        t = t.select("*", F.when(F.col("_m"), corr_k("_s", "_b", p, key=["ticker", "_m"]))
                     .alias(f"high_volume_price_correlation_{p}d")).drop("_m")
    return t


def relative_momentum(df: DataFrame, periods=REL_MOMENTUM_PERIODS) -> DataFrame:
    return df.select("*", *[(div(div("close", lag("close", p)), div("bclose", lag("bclose", p))) - 1)
                            .alias(f"relative_momentum_{p}d") for p in periods])


def tracking_error(df: DataFrame, periods=TRACKING_PERIODS) -> DataFrame:
    t = returns(df)
    return t.select("*", *[std("_ex", p).alias(f"tracking_error_{p}d") for p in periods])


def information_ratio(df: DataFrame, periods=INFO_PERIODS) -> DataFrame:
    t = returns(df)
    return t.select("*", *[div(sma("_ex", p), std("_ex", p)).alias(f"information_ratio_{p}d") for p in periods])


def index_contribution(df: DataFrame) -> DataFrame:
    t = returns(df if "estimated_index_weight" in df.columns else index_weight(df))
    return t.select("*", (F.col("_s") * F.col("estimated_index_weight")).alias("estimated_index_contribution"))


def variance_explained(df: DataFrame, periods=VAR_EXPLAINED_PERIODS) -> DataFrame:
    t = returns(df if "estimated_index_weight" in df.columns else index_weight(df))
    return t.select("*", *[div(cov_k("_s", "_b", p) * F.col("estimated_index_weight"), var_k("_b", p))
                           .alias(f"index_variance_explained_{p}d") for p in periods])


def relative_family(df: DataFrame) -> DataFrame:
    for f in (index_ratio, excess_return, relative_volatility, rolling_beta, rolling_corr, relative_strength,
              volume_vs_index, index_weight, volume_participation, volume_spike, vw_excess_return,
              vw_correlation, high_volume_corr, relative_momentum, tracking_error, information_ratio,
              index_contribution, variance_explained):
        df = f(df)
    return _done(df)
