"""Report tables: risk/return, CAPM risk, sector stats, drawdown, distributions, correlation matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.series import CUM, div, pct, std
from barlens.session import checkpoint_dir

TRADING_DAYS = 252
RISK_FREE = 0.02


def trailing_excess(bars: DataFrame, bench: DataFrame, horizon: int = 5, min_common: int = 50) -> DataFrame:
    """Trailing ``horizon``-bar returns of each series and of the benchmark on common dates
    (tickers with fewer than ``min_common`` common dates are skipped)."""
    s = bars.select("ticker", "date", pct("close", horizon).alias("stock_return")).filter(F.col("stock_return").isNotNull())
    b = bench.select("date", F.try_divide(F.col("close"), F.lag("close", horizon).over(Window.orderBy("date"))).alias("_g"))
    b = b.select("date", (F.col("_g") - 1).alias("benchmark_return"))
    j = s.join(F.broadcast(b), "date")
    j = j.select("*", F.count("*").over(Window.partitionBy("ticker")).alias("_n")).filter(F.col("_n") >= min_common).drop("_n")
    ex = F.col("stock_return") - F.col("benchmark_return")
    return j.select("*", ex.alias("excess_return"), F.coalesce(ex > 0, F.lit(False)).cast("int").alias("outperforms"))


def risk_return(te: DataFrame) -> DataFrame:
    """Per ticker mean, sample std of the trailing return and the out-performance rate (round 4)."""
    from barlens.functions.series import round_half_away as r4

    return te.groupBy("ticker").agg(
        r4(F.avg("stock_return"), 4).alias("mean_return"),
        r4(F.stddev_samp("stock_return"), 4).alias("volatility"),
        r4(F.avg("outperforms"), 4).alias("outperf_rate"),
    )


def annual_risk(bars: DataFrame, bench: DataFrame, min_rows: int = 252, min_aligned: int = 100) -> DataFrame:
    """Annualised return, volatility, Sharpe (rf 2 %), beta = cov(ddof 1) / var(ddof 0), CAPM alpha."""
    n = bars.select("*", F.count("*").over(Window.partitionBy("ticker")).alias("_n")).filter(F.col("_n") >= min_rows)
    s = n.select("ticker", "date", pct("close", 1).alias("s"))
    b = bench.select("date", (F.try_divide(F.col("close"), F.lag("close", 1).over(Window.orderBy("date"))) - 1).alias("b"))
    j = s.join(F.broadcast(b), "date").na.drop(subset=["s", "b"])
    g = j.groupBy("ticker").agg(
        F.count("*").alias("n_aligned"),
        (F.avg("s") * TRADING_DAYS).alias("annual_return"),
        (F.stddev_samp("s") * math.sqrt(TRADING_DAYS)).alias("volatility"),
        (F.avg("b") * TRADING_DAYS).alias("bench_return"),
        F.covar_samp("s", "b").alias("_cov"),
        F.var_pop("b").alias("_varb"),
    ).filter(F.col("n_aligned") >= min_aligned)
    beta = F.when(F.col("_varb") > 0, F.col("_cov") / F.col("_varb")).otherwise(F.lit(0.0))
    sharpe = F.when(F.col("volatility") > 0, (F.col("annual_return") - RISK_FREE) / F.col("volatility")).otherwise(F.lit(0.0))
    g = g.select("*", beta.alias("beta"), sharpe.alias("sharpe_ratio"))
    alpha = F.col("annual_return") - (F.lit(RISK_FREE) + F.col("beta") * (F.col("bench_return") - RISK_FREE))
    return g.select("ticker", "n_aligned", "annual_return", "volatility", "sharpe_ratio", "beta", alpha.alias("alpha"))


def max_drawdown(bars: DataFrame) -> DataFrame:
    """Per row: drawdown % from the running peak of the cumulative growth C/C_first; per ticker the
    minimum is the max drawdown.  (The product of (1 + r) telescopes to C / C_first.)"""
    first = F.first("close").over(CUM())
    cum = F.try_divide(F.col("close"), first)
    t = bars.select("ticker", "date", cum.alias("cum_growth"))
    peak = F.max("cum_growth").over(CUM())
    return t.select("*", ((F.try_divide(F.col("cum_growth"), peak) - 1.0) * 100.0).alias("drawdown_pct"))


def ticker_performance(bars: DataFrame, min_rows: int = 100) -> DataFrame:
    """Per ticker total return %, annualised volatility %, max drawdown %, return/volatility ratio."""
    dd = max_drawdown(bars).groupBy("ticker").agg(F.min("drawdown_pct").alias("max_drawdown"))
    r = bars.select("ticker", "date", "close", pct("close", 1).alias("r"))
    g = r.groupBy("ticker").agg(
        F.count("*").alias("n"),
        ((F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1.0) * 100.0).alias("total_return"),
        (F.stddev_samp("r") * math.sqrt(TRADING_DAYS) * 100.0).alias("volatility"),
    ).filter(F.col("n") >= min_rows)
    g = g.join(dd, "ticker")
    ratio = F.when(F.col("volatility") > 0, F.col("total_return") / F.col("volatility")).otherwise(F.lit(0.0))
    return g.select("ticker", "total_return", "volatility", "max_drawdown", ratio.alias("sharpe_ratio"))


def sector_performance(perf: DataFrame, sectors: DataFrame) -> DataFrame:
    from barlens.operators.joins import sector_lookup

    t = sector_lookup(perf, sectors)
    return t.groupBy("sector").agg(F.avg("total_return").alias("avg_return"), F.avg("volatility").alias("avg_volatility"),
                                   F.avg("sharpe_ratio").alias("avg_sharpe"), F.count("*").alias("count"))


def box_stats(df: DataFrame, value: str, key: str = "ticker") -> DataFrame:
    """min / q1 / median / q3 / max per group (exact percentiles)."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(key).agg(F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max"), F.count(value).alias("n"))
    return g.select(key, "n", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q3"), "max")


def histogram(df: DataFrame, value: str, bins: int, key: str | None = None) -> DataFrame:
    """Equal-width bins between the (per-key) min and max; the max falls into the last bin, empty bins
    count 0.  Bounds and counts are aggregates (a row per key, a row per key and bin), so no task holds
    all rows of a key."""
    keys = [key] if key else []
    v = df.filter(F.col(value).isNotNull()).select(*keys, value)
    lim = v.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).filter(F.col("_lo").isNotNull())
    if keys:
        t = v.join(lim, keys)
    else:
        t = v.select(value, v.select(F.min(value)).scalar().alias("_lo"), v.select(F.max(value)).scalar().alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    n = t.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"))
    every = lim.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(n, [*keys, "bin"], "left")
    return every.select(*keys, "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                        F.coalesce("count", F.lit(0)).alias("count"))


def unit_returns(bars: DataFrame, bench: DataFrame, bench_name: str = "SPY") -> DataFrame:
    """``series, last, z``: per series (the benchmark has ``last`` = true) the daily returns, in date order, less their
    mean and divided by the root of their squares, so that a correlation is the product of two such arrays.

    Returns run between the dates on which every series has a close, and only dates on which every series has a return
    count.  ``z`` is null without variance.  One bar per series and date, so an array is bounded by the calendar."""
    checkpoint_dir(bars.sparkSession)
    rows = bars.select("ticker", F.lit(False).alias("last"), "date", "close")
    rows = rows.unionByName(bench.select(F.lit(bench_name).alias("ticker"), F.lit(True).alias("last"), "date", "close"))
    rows = rows.checkpoint(eager=True)  # bars-sized; the trades behind it are read once
    key, every = ["last", "ticker"], rows.select("last", "ticker").distinct().agg(F.count("*")).scalar()

    def whole(t, value):  # the rows of dates on which each series has a value
        full = t.groupBy("date").agg(F.count(value).alias("has")).where(F.col("has") == every).select("date")
        return t.join(full, "date", "leftsemi")

    before = F.lag("close").over(Window.partitionBy(*key).orderBy("date"))
    r = whole(rows, "close").select(*key, "date", (F.try_divide("close", before) - 1).alias("r"))
    g = whole(r, "r").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("date", "r"))).alias("x"), F.avg("r").alias("m"))
    g = g.select(*key, F.expr("transform(x, e -> e.r - m)").alias("d"))
    size = F.sqrt(F.expr("aggregate(d, 0D, (a, e) -> a + e * e)"))
    return g.select(F.col("ticker").alias("series"), "last", F.when(size > 0, F.transform("d", lambda e: e / size)).alias("z"))


def return_corr_matrix(bars: DataFrame, bench: DataFrame, threshold: float = 0.6, bench_name: str = "SPY",
                       per_block: int = 256) -> DataFrame:
    """Daily-return correlations of every ticker pair (and the benchmark) on the dates where all closes exist, with an
    edge flag for ``|corr| >= threshold``; ``a`` before ``b`` by name, the benchmark last.

    A blocked matrix product: series are dealt by hash over blocks of about ``per_block``, each pair of blocks is one
    task's product, and a series travels once per block.  The universe never comes to the driver, a task holds two
    blocks, and rows grow with the matrix that is asked for.  Correlations without variance are null."""
    unit = unit_returns(bars, bench, bench_name).checkpoint(eager=True)
    blocks = max(1, math.ceil(unit.count() / per_block))
    own = F.pmod(F.xxhash64("last", "series"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    t = unit.withColumn("own", own).select("*", other.alias("other"))
    t = t.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "last", "series", "z")

    def product(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["last", "series"], ignore_index=True)
        days = max((len(z) for z in part["z"] if z is not None), default=0)
        none = np.full(days, np.nan)
        z = np.stack([none if v is None else np.asarray(v, np.float64) for v in part["z"]])
        inside = part["own"].to_numpy()
        if key[0] == key[1]:
            a, b = np.triu_indices(len(part), 1)
            corr = (z @ z.T)[a, b] if days else np.full(len(a), np.nan)
        else:
            left, right = np.flatnonzero(inside == key[0]), np.flatnonzero(inside == key[1])
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            corr = (z[left] @ z[right].T).ravel() if days else np.full(len(x), np.nan)
            a, b = np.minimum(x, y), np.maximum(x, y)
        names = part["series"].to_numpy()
        return pd.DataFrame({"a": names[a], "b": names[b], "corr": corr})

    out = t.groupBy("i", "j").applyInPandas(product, "a string, b string, corr double")
    return out.select("a", "b", F.nanvl("corr", F.lit(None).cast("double")).alias("corr")).withColumn("edge", F.abs("corr") >= threshold)


def _pair_corr(x: str, y: str):
    xj = F.when(F.col(y).isNotNull(), F.col(x))
    yj = F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_samp(xj, yj), F.stddev_samp(xj) * F.stddev_samp(yj))


def feature_target_corr(df: DataFrame, features: list[str], target: str = "outperforms") -> DataFrame:
    one = df.agg(*[_pair_corr(c, target).alias(c) for c in features])
    return one.unpivot([], features, "feature", "corr").select("feature", "corr", F.abs("corr").alias("abs_corr"))


def rolling_vol_report(bars: DataFrame, bench: DataFrame, window: int = 20, bench_name: str = "market") -> DataFrame:
    """Annualised rolling volatility in % for the benchmark and every ticker, then the mean per series."""
    s = bars.select("ticker", "date", pct("close", 1).alias("r"))
    s = s.select("ticker", "date", (std("r", window) * math.sqrt(TRADING_DAYS) * 100.0).alias("vol"))
    b = bench.select(F.lit(bench_name).alias("ticker"), "date", pct("close", 1, key=[]).alias("r"))
    b = b.select("ticker", "date", (std("r", window, key=[]) * math.sqrt(TRADING_DAYS) * 100.0).alias("vol"))
    u = s.unionByName(b).filter(F.col("vol").isNotNull())
    return u.groupBy("ticker").agg(F.avg("vol").alias("avg_volatility"), F.count("*").alias("n"))
