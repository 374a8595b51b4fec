"""Full feature table: every family in the reference order, first duplicate name wins, then the
reference's fill chain (backward fill, per-ticker sparse-column null-out, per-ticker median).

Features that reach back without bound (recursive smoothing, running sums, correlations over a filtered sub-series) are
computed on whole series.  All others look back ``HALO`` rows at most, so a series is cut into blocks of rows, each block takes
the ``HALO`` rows before it along, and blocks spread over tasks like series of their own.  A finished family travels on
as one array column: later windows copy a few columns, not all features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.series import W
from barlens.operators import clean
from barlens.operators.features import advanced as A
from barlens.operators.features import momentum as M
from barlens.operators.features import price as P
from barlens.operators.features import relative as RL
from barlens.operators.features import technical as T
from barlens.operators.features import trend as TR
from barlens.operators.features import volatility as V
from barlens.operators.features import volume as VO
from barlens.operators.features.calendar import interactions, seasonality
from barlens.operators.joins import asof_benchmark
from barlens.session import checkpoint_dir
from barlens.sources.bars import series_partitioned

KEYS = ("ticker", "date")
BASIC = ["close", "open", "high", "low", "volume"]

#: rows that a block takes along: two nested 252-row windows (the index weight) reach back furthest
HALO = 512

FAMILIES = [
    [P.price_ratios, P.intraday_returns, P.candle_shape, P.multi_day_returns],
    [T.sma_features, T.ema_features, T.rsi, T.bollinger, T.macd, T.atr, T.volume_sma, T.obv, T.stochastic, T.cci, T.williams_r],
    [VO.volume_change, VO.volume_ma, VO.vpt, VO.nvi, VO.price_volume_corr],
    [M.roc, M.momentum, M.acceleration, M.rs_sma],
    [V.volatility, V.volatility_rank, V.vol_ratio, V.realized_vol, V.vol_clustering],
    [TR.ma_trend, TR.price_ma_position, TR.trend_slope, TR.ma_convergence],
    [A.momentum_cross, A.vol_regime, A.pvt, A.vwap_deviation, A.volume_momentum, A.mean_reversion, A.adx, A.vol_regime_change, A.market_correlation],
]
RELATIVE = [RL.index_ratio, RL.excess_return, RL.relative_volatility, RL.rolling_beta, RL.rolling_corr, RL.relative_strength,
            RL.volume_vs_index, RL.index_weight, RL.volume_participation, RL.volume_spike, RL.vw_excess_return, RL.vw_correlation,
            RL.high_volume_corr, RL.relative_momentum, RL.tracking_error, RL.information_ratio, RL.index_contribution,
            RL.variance_explained]
#: functions of all earlier rows
UNBOUNDED = {T.ema_features, T.rsi, T.macd, T.atr, T.obv, VO.vpt, VO.nvi, A.pvt, RL.high_volume_corr}
#: features that later families use again
SHARED = {"daily_return", "sma_5", "sma_10", "sma_20", "sma_50", "volume_sma", "volatility_10"}


def _apply(df: DataFrame, functions, taken: set[str], made: dict, drop_helpers: bool = True) -> DataFrame:
    """``df`` after ``functions``; ``made`` gets, per function, its new columns that no earlier one has (name -> type)."""
    start = set(df.columns)
    for f in functions:
        before = set(df.columns)
        df = f(df)
        types = dict(df.dtypes)
        made[f] = {c: types[c] for c in df.columns if c not in before and c not in taken and not c.startswith("_")}
        taken |= set(made[f])
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in start]) if drop_helpers else df


def _pack(df: DataFrame, keep: list[str], names: list[str], pack: str) -> DataFrame:
    shared = [c for c in df.columns if c in SHARED and c not in keep]
    return df.selectExpr(*keep, *shared, _array(names, pack))


def _array(names: list[str], pack: str) -> str:
    # projections as wide as the feature table are SQL text: built much faster than column objects
    return f"array({', '.join(f'cast({c} AS double)' for c in names)}) AS {pack}"


def engineer(bars: DataFrame, bench: DataFrame | None = None, with_seasonality: bool = False,
             with_interactions: bool = False, fill_mode: str = "reference", block_rows: int = 4096) -> DataFrame:
    """``fill_mode``: "reference" (bfill + sparse null-out + median, leaks future values into warm-up
    rows exactly like the reference) or "none" (leave warm-up NULLs; leak-free).  ``block_rows``: rows of a series
    that one task computes; results do not depend on it.  Two tables of the size of the result are checkpointed."""
    checkpoint_dir(bars.sparkSession)
    df = bars.select(*KEYS, *BASIC)
    relative = RELATIVE if bench is not None else []
    if relative:
        df = asof_benchmark(df, bench)
    base = ["ticker", *[c for c in df.columns if c != "ticker"]]

    # whole series: what reaches back without bound, and the place of each row in its blocks
    taken, made = set(base), {}
    whole = _apply(df, [f for fs in [*FAMILIES, relative] for f in fs if f in UNBOUNDED], taken, made)
    names = [c for f in made for c in made[f]]
    types = {c: t for f in made for c, t in made[f].items()}
    place, rows = F.row_number().over(W()) - 1, F.count("*").over(Window.partitionBy("ticker"))
    whole = whole.select(*base, place.alias("place"), rows.alias("rows"), F.expr(_array(names, "pack0")))
    block = F.floor(F.col("place") / block_rows)
    last = F.least(F.floor((F.col("place") + HALO) / block_rows), F.floor((F.col("rows") - 1) / block_rows))
    whole = whole.checkpoint(eager=True)
    t = whole.select(*base[1:], F.col("ticker").alias("series"), block.alias("own"), "pack0", F.explode(F.sequence(block, last)).alias("block"))
    t = series_partitioned(t.select(F.struct("series", "block").alias("ticker"), *base[1:], "series", "own", "pack0"))

    # blocks: everything else
    keep, packs = [*base, "series", "own", "pack0"], [names]
    for fs in [*FAMILIES, relative]:
        new: dict = {}
        t = _apply(t, [f for f in fs if f not in UNBOUNDED], taken, new)
        made |= new
        names = [c for f in new for c in new[f]]
        types |= {c: d for f in new for c, d in new[f].items()}
        if names:
            t = _pack(t, keep, names, f"pack{len(packs)}")
            keep.append(f"pack{len(packs)}")
            packs.append(names)
    at = {c: f"cast(pack{k}[{i}] AS {types[c]}) AS {c}" for k, names in enumerate(packs) for i, c in enumerate(names)}
    order = lambda fs: [at[c] for f in fs for c in made[f]]
    t = t.filter(F.col("ticker.block") == F.col("own"))
    t = t.selectExpr("series AS ticker", "date", *BASIC, *[c for fs in FAMILIES for c in order(fs)], *order(relative), "own AS block")
    feats = [c for c in t.columns if c not in (*KEYS, "block")]
    extra = feats[len(feats) - sum(len(made[f]) for f in relative):] if relative else []
    if with_seasonality:
        t = seasonality(t)
    if with_interactions:
        t = interactions(t)
    added = [c for c in t.columns if c not in (*KEYS, "block", *feats)]
    feats = [c for c in feats if c not in extra] + added + extra
    t = t.select(*KEYS, *feats, "block")
    if fill_mode == "reference":
        t = clean.fill_chain(t.checkpoint(eager=True), feats, "block")
    return t.select(*KEYS, *feats)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]
