"""Registered feature queries: bars (ticker = p_type) -> one feature family operator -> rounded output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlens.functions.series import rnd
from barlens.operators import labels as L
from barlens.operators.features import advanced as A
from barlens.operators.features import calendar as C
from barlens.operators.features import momentum as M
from barlens.operators.features import price as P
from barlens.operators.features import relative as RL
from barlens.operators.features import technical as T
from barlens.operators.features import trend as TR
from barlens.operators.features import volatility as V
from barlens.operators.features import volume as VO
from barlens.operators.joins import asof_benchmark
from barlens.sources.bars import as_benchmark, bars, market_gappy


def relative_bars(spark: SparkSession, sf: str, ticker: str = "p_type") -> DataFrame:
    """Bars with the weekday-only benchmark attached as of each bar's date."""
    return asof_benchmark(bars(spark, sf, ticker), as_benchmark(market_gappy(spark, sf)))


def _q(fn, cols, relative=False, ticker="p_type"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        b = relative_bars(spark, sf, ticker) if relative else bars(spark, sf, ticker)
        return rnd(fn(b).select("ticker", "date", *cols))
    run.__doc__ = f"{getattr(fn, '__name__', fn)} -> {', '.join(cols)}"
    run.cols = cols
    return run


def _p(name, periods):
    return [name.format(p=p) for p in periods]


def _seasonality_cols():
    return ["day_of_week", "is_monday", "is_friday", "month", "is_january", "is_december", "quarter", "is_q1",
            "is_q4", "is_month_start", "is_month_end", "day_of_month", "is_first_week", "is_last_week",
            "is_near_holidays"]


def _interaction_cols():
    from itertools import combinations
    out = []
    for a, b in combinations(C.KEY_FEATURES, 2):
        out += [f"{a}_x_{b}", f"{a}_div_{b}"]
    return out + ["rsi_volume_strength"]


def _interactions(df):
    return C.interactions(T.bollinger(T.macd(T.sma_features(T.volume_sma(T.rsi(df))))))


QUERIES = {
    # price family
    "basic_price": _q(lambda d: d, ["close", "open", "high", "low", "volume"]),
    "price_ratios": _q(P.price_ratios, ["high_low_ratio", "close_open_ratio", "high_close_ratio", "low_close_ratio"]),
    "intraday_returns": _q(P.intraday_returns, ["daily_return", "overnight_return", "intraday_return"]),
    "candle_shape": _q(P.candle_shape, ["high_low_spread", "body_size", "upper_shadow", "lower_shadow"]),
    "multi_day_returns": _q(P.multi_day_returns, [c for p in P.RETURN_PERIODS for c in (f"return_{p}d", f"volatility_{p}d")]),
    "basic_features": _q(P.basic_features, ["close", "open", "high", "low", "volume", "price_range", "open_close_ratio",
                                            "high_close_ratio", "low_close_ratio", "return_1d", "return_5d", "return_20d",
                                            "volume_ratio"]),
    "seasonality": _q(C.seasonality, _seasonality_cols()),
    "interactions": _q(_interactions, _interaction_cols()),
    # technical
    "sma": _q(T.sma_features, [c for p in T.SMA_PERIODS for c in (f"sma_{p}", f"close_sma_{p}_ratio")]),
    "ema": _q(T.ema_features, [c for p in T.EMA_PERIODS for c in (f"ema_{p}", f"close_ema_{p}_ratio")]),
    "rsi": _q(T.rsi, ["rsi"]),
    "bollinger": _q(T.bollinger, ["bb_upper", "bb_lower", "bb_middle", "bb_width", "bb_position"]),
    "macd": _q(T.macd, ["macd", "macd_signal", "macd_histogram"]),
    "atr": _q(T.atr, ["atr", "atr_ratio"]),
    "volume_sma": _q(T.volume_sma, ["volume_sma", "volume_ratio"]),
    "obv": _q(T.obv, ["obv"]),
    "stochastic": _q(T.stochastic, ["stoch_k", "stoch_d"]),
    "cci": _q(T.cci, ["cci"]),
    "williams_r": _q(T.williams_r, ["williams_r"]),
    # volume
    "volume_change": _q(VO.volume_change, ["volume_change"]),
    "volume_ma": _q(VO.volume_ma, [c for p in VO.VOLUME_MA_PERIODS for c in (f"volume_ma_{p}", f"volume_ratio_{p}")]),
    "vpt": _q(VO.vpt, ["volume_price_trend"]),
    "nvi": _q(VO.nvi, ["negative_volume_index"]),
    "price_volume_corr": _q(VO.price_volume_corr, _p("price_volume_corr_{p}", VO.PV_CORR_PERIODS)),
    # momentum
    "roc": _q(M.roc, _p("roc_{p}", M.ROC_PERIODS)),
    "momentum": _q(M.momentum, _p("momentum_{p}", M.MOMENTUM_PERIODS)),
    "acceleration": _q(M.acceleration, _p("acceleration_{p}", M.ACCELERATION_PERIODS)),
    "rs_sma": _q(M.rs_sma, _p("rs_sma_{p}", M.TREND_PERIODS)),
    # volatility
    "volatility": _q(V.volatility, _p("volatility_{p}", V.VOLATILITY_PERIODS)),
    "volatility_rank": _q(V.volatility_rank, _p("volatility_rank_{p}", V.VOLATILITY_PERIODS)),
    "vol_ratio": _q(V.vol_ratio, ["vol_ratio_5_20"]),
    "realized_vol": _q(V.realized_vol, ["realized_vol"]),
    "vol_clustering": _q(V.vol_clustering, ["vol_clustering"]),
    # trend
    "ma_trend": _q(TR.ma_trend, _p("ma_trend_{p}", TR.TREND_PERIODS)),
    "price_ma_position": _q(TR.price_ma_position, _p("price_ma_position_{p}", TR.TREND_PERIODS)),
    "trend_slope": _q(TR.trend_slope, _p("trend_strength_{p}", TR.SLOPE_PERIODS)),
    "ma_convergence": _q(TR.ma_convergence, ["ma_convergence_10_50", "ma_convergence_20_50"]),
    # advanced
    "momentum_cross": _q(A.momentum_cross, [c for f, s in A.CROSS_PAIRS for c in (f"momentum_cross_{f}_{s}", f"momentum_strength_{f}_{s}")]),
    "vol_regime": _q(A.vol_regime, [c for w in A.REGIME_PERIODS for c in (f"volatility_{w}d", f"vol_regime_{w}d")]),
    "pvt": _q(A.pvt, ["pvt"]),
    "vwap_deviation": _q(A.vwap_deviation, ["vwap_deviation"]),
    "volume_momentum": _q(A.volume_momentum, ["volume_momentum"]),
    "mean_reversion": _q(A.mean_reversion, [c for p in A.MEAN_REVERSION_PERIODS for c in (f"mean_reversion_{p}", f"price_zscore_{p}")]),
    "adx": _q(A.adx, _p("trend_strength_{p}", A.ADX_PERIODS)),
    "vol_regime_change": _q(A.vol_regime_change, ["vol_regime_change"]),
    "market_correlation": _q(A.market_correlation, ["market_correlation"], True),
    # relative to the (as-of aligned) benchmark
    "index_ratio": _q(RL.index_ratio, ["stock_index_ratio", "stock_index_ratio_change"], True),
    "excess_return": _q(RL.excess_return, ["excess_return_1d"] + [c for p in RL.EXCESS_PERIODS for c in (f"excess_return_{p}d", f"relative_return_{p}d")], True),
    "relative_volatility": _q(RL.relative_volatility, _p("relative_volatility_{p}d", RL.REL_VOL_PERIODS), True),
    "rolling_beta": _q(RL.rolling_beta, _p("beta_{p}d", RL.BETA_PERIODS), True),
    "rolling_corr": _q(RL.rolling_corr, _p("correlation_{p}d", RL.CORR_PERIODS), True),
    "relative_strength": _q(RL.relative_strength, [c for p in RL.STRENGTH_PERIODS for c in (f"relative_strength_{p}d", f"relative_ma_{p}d")], True),
    "volume_vs_index": _q(RL.volume_vs_index, ["volume_ratio_vs_index"], True),
    "index_weight": _q(RL.index_weight, ["estimated_index_weight", "weight_adjusted_volume"], True),
    "volume_participation": _q(RL.volume_participation, ["volume_participation_ratio", "volume_leadership"], True),
    "volume_spike": _q(RL.volume_spike, [c for p in RL.SPIKE_PERIODS for c in (f"volume_spike_correlation_{p}d", f"volume_leadership_strength_{p}d")], True),
    "vw_excess_return": _q(RL.vw_excess_return, ["volume_weighted_excess_return"], True),
    "vw_correlation": _q(RL.vw_correlation, _p("volume_weighted_correlation_{p}d", RL.VW_CORR_PERIODS), True),
    "high_volume_corr": _q(RL.high_volume_corr, _p("high_volume_price_correlation_{p}d", RL.HIGH_VOL_PERIODS), True),
    "relative_momentum": _q(RL.relative_momentum, _p("relative_momentum_{p}d", RL.REL_MOMENTUM_PERIODS), True),
    "tracking_error": _q(RL.tracking_error, _p("tracking_error_{p}d", RL.TRACKING_PERIODS), True),
    "information_ratio": _q(RL.information_ratio, _p("information_ratio_{p}d", RL.INFO_PERIODS), True),
    "index_contribution": _q(RL.index_contribution, ["estimated_index_contribution"], True),
    "variance_explained": _q(RL.variance_explained, _p("index_variance_explained_{p}d", RL.VAR_EXPLAINED_PERIODS), True),
    "cum_excess": _q(L.cum_excess, ["trailing_excess", "cum_excess"], True),
}

#: the queries whose columns make up the engineered table, in its order
ENGINEERED = [
    "basic_price", "price_ratios", "intraday_returns", "candle_shape", "multi_day_returns",
    "sma", "ema", "rsi", "bollinger", "macd", "atr", "volume_sma", "obv", "stochastic", "cci", "williams_r",
    "volume_change", "volume_ma", "vpt", "nvi", "price_volume_corr", "roc", "momentum", "acceleration", "rs_sma",
    "volatility", "volatility_rank", "vol_ratio", "realized_vol", "vol_clustering",
    "ma_trend", "price_ma_position", "trend_slope", "ma_convergence",
    "momentum_cross", "vol_regime", "pvt", "vwap_deviation", "volume_momentum", "mean_reversion", "adx", "vol_regime_change", "market_correlation",
    "index_ratio", "excess_return", "relative_volatility", "rolling_beta", "rolling_corr", "relative_strength", "volume_vs_index",
    "index_weight", "volume_participation", "volume_spike", "vw_excess_return", "vw_correlation", "high_volume_corr",
    "relative_momentum", "tracking_error", "information_ratio", "index_contribution", "variance_explained",
]

#: the columns of that table; of two of one name the first counts
ENGINEERED_COLS = list(dict.fromkeys(c for name in ENGINEERED for c in QUERIES[name].cols))
