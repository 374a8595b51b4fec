"""DuckDB oracle SQL for the feature queries (hand-written; shares no code with the Spark side)."""

from __future__ import annotations

from barlens.plans.sqlkit import (
    PART, base, corr, cov, cum, div, ema, ewm, frame, lag, pct, roll, rounded, running, sma, std,
)

B = base()
RB = base(relative=True)


def q(select: str, src: str = "bars", stages: str = "", rel: bool = False) -> str:
    """``stages`` are extra CTEs (each starting with a comma); the final select reads ``src``."""
    return (RB if rel else B) + stages + "\n" + rounded(f"SELECT ticker, date, {select} FROM {src}")


def cols(*exprs: str) -> str:
    return ", ".join(exprs)


def _stages(*defs: tuple[str, str, str]) -> str:
    """(name, source, select-list) -> ', name AS (SELECT *, <list> FROM source)'."""
    return "".join(f",\n{n} AS (SELECT *, {sel} FROM {src})" for n, src, sel in defs)


O: dict[str, str] = {}

# ---- price family ------------------------------------------------------------------------------
O["basic_price"] = q("close, open, high, low, volume")
O["price_ratios"] = q(cols(f"{div('high', 'low')} AS high_low_ratio", f"{div('close', 'open')} AS close_open_ratio",
                           f"{div('high', 'close')} AS high_close_ratio", f"{div('low', 'close')} AS low_close_ratio"))
O["intraday_returns"] = q(cols(f"{pct('close')} AS daily_return", f"({div('open', lag('close'))} - 1) AS overnight_return",
                               f"({div('close', 'open')} - 1) AS intraday_return"))
O["candle_shape"] = q(cols(f"{div('high - low', 'close')} AS high_low_spread", f"{div('abs(close - open)', 'close')} AS body_size",
                           f"{div('high - greatest(open, close)', 'close')} AS upper_shadow",
                           f"{div('least(open, close) - low', 'close')} AS lower_shadow"))
O["multi_day_returns"] = q(
    cols(*[f"{pct('close', p)} AS return_{p}d, {std('daily_return', p)} AS volatility_{p}d" for p in (2, 3, 5, 10, 20)]),
    "t1", _stages(("t1", "bars", f"{pct('close')} AS daily_return")))
O["basic_features"] = q(cols(
    "close, open, high, low, volume", f"{div('high - low', 'close')} AS price_range", f"{div('open', 'close')} AS open_close_ratio",
    f"{div('high', 'close')} AS high_close_ratio", f"{div('low', 'close')} AS low_close_ratio", f"{pct('close', 1)} AS return_1d",
    f"{pct('close', 5)} AS return_5d", f"{pct('close', 20)} AS return_20d", f"{div('volume', sma('volume', 20))} AS volume_ratio"))


def _flag(cond: str) -> str:
    return f"CAST(({cond}) AS INTEGER)"


O["seasonality"] = B + "\n" + f"""SELECT ticker, date,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, {_flag('isodow(date) = 1')} AS is_monday, {_flag('isodow(date) = 5')} AS is_friday,
  CAST(month(date) AS INTEGER) AS month, {_flag('month(date) = 1')} AS is_january, {_flag('month(date) = 12')} AS is_december,
  CAST(quarter(date) AS INTEGER) AS quarter, {_flag('quarter(date) = 1')} AS is_q1, {_flag('quarter(date) = 4')} AS is_q4,
  {_flag('day(date) = 1')} AS is_month_start, {_flag('date = last_day(date)')} AS is_month_end,
  CAST(day(date) AS INTEGER) AS day_of_month, {_flag('day(date) <= 7')} AS is_first_week, {_flag('day(date) >= 24')} AS is_last_week,
  {_flag('(month(date) = 12 AND day(date) >= 20) OR (month(date) = 1 AND day(date) <= 5) OR (month(date) = 11 AND day(date) >= 20)')} AS is_near_holidays
FROM bars"""

# ---- technical ---------------------------------------------------------------------------------
O["sma"] = q(cols(*[f"{sma('close', p)} AS sma_{p}, {div('close', sma('close', p))} AS close_sma_{p}_ratio" for p in (5, 10, 20, 50)]))
O["ema"] = q(cols(*[f"e{p} AS ema_{p}, {div('close', f'e{p}')} AS close_ema_{p}_ratio" for p in (12, 26)]),
             "t1", _stages(("t1", "bars", f"{ema('close', 12)} AS e12, {ema('close', 26)} AS e26")))

_RSI_STAGES = _stages(
    ("r1", "bars", "close - " + lag("close") + " AS d"),
    ("r2", "r1", "CASE WHEN d > 0 THEN d ELSE 0.0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS dn"),
    ("r3", "r2", f"{ewm('up', 1 / 14)} AS eu, {ewm('dn', 1 / 14)} AS ed, count(up) OVER {cum()} AS n_seen"),
    ("r4", "r3", "CASE WHEN n_seen >= 14 THEN (CASE WHEN ed = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + eu / ed) END) END AS rsi"),
)
O["rsi"] = q("rsi", "r4", _RSI_STAGES)

_BB_STAGES = _stages(
    ("b1", "bars", f"{sma('close', 20)} AS bb_middle, {roll('stddev_pop', 'close', 20)} AS sd"),
    ("b2", "b1", "bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower"),
    ("b3", "b2", f"{div('bb_upper - bb_lower', 'bb_middle')} AS bb_width, {div('close - bb_lower', 'bb_upper - bb_lower')} AS bb_position"),
)
O["bollinger"] = q("bb_upper, bb_lower, bb_middle, bb_width, bb_position", "b3", _BB_STAGES)

_MACD_STAGES = _stages(
    ("m1", "bars", f"{ema('close', 12)} - {ema('close', 26)} AS macd"),
    ("m2", "m1", f"{ema('macd', 9)} AS macd_signal"),
    ("m3", "m2", "macd - macd_signal AS macd_histogram"),
)
O["macd"] = q("macd, macd_signal, macd_histogram", "m3", _MACD_STAGES)

_TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
O["atr"] = q("atr, atr_ratio", "a4", _stages(
    ("a1", "bars", f"{_TR} AS tr, row_number() OVER ({PART}) AS rn"),
    ("a2", "a1", f"CASE WHEN rn = 14 THEN avg(tr) OVER {frame(14)} WHEN rn > 14 THEN tr END AS seed"),
    ("a3", "a2", f"CASE WHEN rn < 14 THEN 0.0 ELSE {ewm('seed', 1 / 14)} END AS atr"),
    ("a4", "a3", f"{div('atr', 'close')} AS atr_ratio"),
))
O["volume_sma"] = q(f"{sma('volume', 20)} AS volume_sma, {div('volume', sma('volume', 20))} AS volume_ratio")
O["obv"] = q(f"sum(step) OVER {cum()} AS obv", "o1",
             _stages(("o1", "bars", f"CASE WHEN close < {lag('close')} THEN -volume ELSE volume END AS step")))
O["stochastic"] = q(f"stoch_k, {sma('stoch_k', 3)} AS stoch_d", "s1", _stages(
    ("s1", "bars", f"100.0 * {div('close - ' + roll('min', 'low', 14), roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))} AS stoch_k")))
_XS = f"list_filter(list(tp) OVER {frame(20)}, lambda v: v IS NOT NULL)"
O["cci"] = q("cci", "c3", _stages(
    ("c1", "bars", "(high + low + close) / 3.0 AS tp"),
    ("c2", "c1", f"list_reduce({_XS}, lambda a, v: a + v, CAST(0.0 AS DOUBLE)) / len({_XS}) AS m, {_XS} AS xs"),
    ("c3", "c2", f"CASE WHEN count(tp) OVER {frame(20)} = 20 THEN "
                 f"{div('tp - ' + sma('tp', 20), '0.015 * (list_reduce(list_transform(xs, lambda v: abs(v - m)), lambda a, v: a + v, CAST(0.0 AS DOUBLE)) / len(xs))')} END AS cci"),
))
O["williams_r"] = q(f"-100.0 * {div(roll('max', 'high', 14) + ' - close', roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))} AS williams_r")

# ---- volume ------------------------------------------------------------------------------------
O["volume_change"] = q(f"{pct('volume')} AS volume_change")
O["volume_ma"] = q(cols(*[f"{sma('volume', p)} AS volume_ma_{p}, {div('volume', sma('volume', p))} AS volume_ratio_{p}" for p in (5, 10, 20, 50)]))
O["vpt"] = q(f"{running('+', 'x')} AS volume_price_trend", "v1", _stages(("v1", "bars", f"volume * {pct('close')} AS x")))
O["nvi"] = q(f"1000.0 * {running('*', 'step')} AS negative_volume_index", "n1", _stages(
    ("n1", "bars", f"CASE WHEN volume < {lag('volume')} THEN 1.0 + {pct('close')} ELSE 1.0 END AS step")))
O["price_volume_corr"] = q(cols(*[f"{corr('pc', 'vc', p)} AS price_volume_corr_{p}" for p in (5, 10, 20)]), "p1",
                           _stages(("p1", "bars", f"{pct('close')} AS pc, {pct('volume')} AS vc")))

# ---- momentum ----------------------------------------------------------------------------------
O["roc"] = q(cols(*[f"100.0 * {pct('close', p)} AS roc_{p}" for p in (10, 20)]))
O["momentum"] = q(cols(*[f"({div('close', lag('close', p))} - 1) AS momentum_{p}" for p in (5, 10, 20)]))
O["acceleration"] = q(cols(*[f"r{p} - {lag(f'r{p}', p)} AS acceleration_{p}" for p in (5, 10)]), "a1",
                      _stages(("a1", "bars", f"{pct('close', 5)} AS r5, {pct('close', 10)} AS r10")))
O["rs_sma"] = q(cols(*[f"{div('close - ' + sma('close', p), sma('close', p))} AS rs_sma_{p}" for p in (10, 20, 50)]))

# ---- volatility --------------------------------------------------------------------------------
_VOL = _stages(("v1", "bars", f"{pct('close')} AS r"),
               ("v2", "v1", cols(*[f"{std('r', p)} AS volatility_{p}" for p in (5, 10, 20)])))
O["volatility"] = q("volatility_5, volatility_10, volatility_20", "v2", _VOL)


def _rank(v: str, k: int) -> str:
    xs = f"list({v}) OVER {frame(k)}"
    below = f"len(list_filter({xs}, lambda e: e < {v}))"
    equal = f"len(list_filter({xs}, lambda e: e = {v}))"
    return f"(CASE WHEN count({v}) OVER {frame(k)} = {k} THEN ({below} + ({equal} + 1) / 2.0) / CAST({k} AS DOUBLE) END)"


O["volatility_rank"] = q(cols(*[f"{_rank(f'volatility_{p}', 2 * p)} AS volatility_rank_{p}" for p in (5, 10, 20)]), "v2", _VOL)
O["vol_ratio"] = q(f"{div('volatility_5', 'volatility_20')} AS vol_ratio_5_20", "v2", _VOL)
O["realized_vol"] = q(f"sqrt(252) * {std('r', 20)} AS realized_vol", "v1", _stages(("v1", "bars", f"{pct('close')} AS r")))
O["vol_clustering"] = q(f"{std('volatility_20', 5)} AS vol_clustering", "v2", _VOL)

# ---- trend -------------------------------------------------------------------------------------
O["ma_trend"] = q(cols(*[f"{div(f'ma{p} - ' + lag(f'ma{p}', 5), lag(f'ma{p}', 5))} AS ma_trend_{p}" for p in (10, 20, 50)]), "t1",
                  _stages(("t1", "bars", cols(*[f"{sma('close', p)} AS ma{p}" for p in (10, 20, 50)]))))
O["price_ma_position"] = q(cols(*[f"{div('close - ' + sma('close', p), sma('close', p))} AS price_ma_position_{p}" for p in (10, 20, 50)]))
O["trend_slope"] = q(cols(*[f"{div('(close - ' + lag('close', p) + f') / {p}.0', std('close', p))} AS trend_strength_{p}" for p in (10, 20)]))
O["ma_convergence"] = q(cols(
    f"{div(sma('close', 10) + ' - ' + sma('close', 50), sma('close', 50))} AS ma_convergence_10_50",
    f"{div(sma('close', 20) + ' - ' + sma('close', 50), sma('close', 50))} AS ma_convergence_20_50"))

# ---- advanced ----------------------------------------------------------------------------------
O["momentum_cross"] = q(cols(*[
    f"CAST(coalesce({sma('close', f)} > {sma('close', s)}, false) AS INTEGER) AS momentum_cross_{f}_{s}, "
    f"{div(sma('close', f) + ' - ' + sma('close', s), sma('close', s))} AS momentum_strength_{f}_{s}"
    for f, s in ((5, 10), (10, 20), (20, 50))]))


def _q252(v: str) -> str:
    return f"(CASE WHEN count({v}) OVER {frame(252)} = 252 THEN quantile_cont({v}, 0.7) OVER {frame(252)} END)"


O["vol_regime"] = q(cols(*[f"av{w} AS volatility_{w}d, CAST(coalesce(av{w} > {_q252(f'av{w}')}, false) AS INTEGER) AS vol_regime_{w}d"
                           for w in (20, 50)]), "g2",
                    _stages(("g1", "bars", f"{pct('close')} AS r"),
                            ("g2", "g1", f"sqrt(252) * {std('r', 20)} AS av20, sqrt(252) * {std('r', 50)} AS av50")))
O["pvt"] = q(f"{running('+', 'x')} AS pvt", "p1",
             _stages(("p1", "bars", f"{div('close - ' + lag('close'), lag('close'))} * volume AS x")))
O["vwap_deviation"] = q(f"{div('close - vwap', 'vwap')} AS vwap_deviation", "w2", _stages(
    ("w1", "bars", "close * volume AS cv"),
    ("w2", "w1", f"{div(roll('sum', 'cv', 20), roll('sum', 'volume', 20))} AS vwap")))
O["volume_momentum"] = q(f"{pct('volume', 5)} AS volume_momentum")
O["mean_reversion"] = q(cols(*[
    f"{div('close - ' + sma('close', p), sma('close', p))} AS mean_reversion_{p}, "
    f"{div('close - ' + sma('close', p), std('close', p))} AS price_zscore_{p}" for p in (10, 20)]))

_ADX = [("d1", "bars", f"CASE WHEN {lag('close')} IS NOT NULL THEN {_TR} END AS tr, "
                       f"high - {lag('high')} AS upm, {lag('low')} - low AS dnm"),
        ("d2", "d1", "CASE WHEN upm > dnm THEN greatest(upm, 0.0) ELSE 0.0 END AS dmp, "
                     "CASE WHEN dnm > upm THEN greatest(dnm, 0.0) ELSE 0.0 END AS dmm")]
for _p in (14, 28):
    _ADX += [(f"d3_{_p}", _ADX[-1][0], f"100.0 * {div(sma('dmp', _p), sma('tr', _p))} AS dip{_p}, 100.0 * {div(sma('dmm', _p), sma('tr', _p))} AS dim{_p}"),
             (f"d4_{_p}", f"d3_{_p}", f"100.0 * {div(f'abs(dip{_p} - dim{_p})', f'dip{_p} + dim{_p}')} AS dx{_p}"),
             (f"d5_{_p}", f"d4_{_p}", f"{sma(f'dx{_p}', _p)} AS trend_strength_{_p}")]
O["adx"] = q("trend_strength_14, trend_strength_28", "d5_28", _stages(*_ADX))
O["vol_regime_change"] = q(f"{div(std('r', 10), std('r', 50))} AS vol_regime_change", "v1", _stages(("v1", "bars", f"{pct('close')} AS r")))
O["market_correlation"] = q(f"{corr('s', 'b', 60)} AS market_correlation", "x1", _stages(("x1", "rbars", f"{pct('close')} AS s, {pct('bclose')} AS b")), rel=True)

# ---- interactions (rsi, volume_ratio, close_sma_20_ratio, macd, bb_position) --------------------
_KEYS = ("rsi", "volume_ratio", "close_sma_20_ratio", "macd", "bb_position")
_INTER = _stages(
    ("r1", "bars", "close - " + lag("close") + " AS d"),
    ("r2", "r1", "CASE WHEN d > 0 THEN d ELSE 0.0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS dn"),
    ("r3", "r2", f"{ewm('up', 1 / 14)} AS eu, {ewm('dn', 1 / 14)} AS ed, count(up) OVER {cum()} AS n_seen, "
                 f"{div('volume', sma('volume', 20))} AS volume_ratio, {div('close', sma('close', 20))} AS close_sma_20_ratio, "
                 f"{ema('close', 12)} - {ema('close', 26)} AS macd, {sma('close', 20)} AS bbm, {roll('stddev_pop', 'close', 20)} AS bsd"),
    ("r4", "r3", "CASE WHEN n_seen >= 14 THEN (CASE WHEN ed = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + eu / ed) END) END AS rsi, "
                 "bbm + 2 * bsd AS bbu, bbm - 2 * bsd AS bbl"),
    ("r5", "r4", f"{div('close - bbl', 'bbu - bbl')} AS bb_position"),
)
_pairs = [(a, b) for i, a in enumerate(_KEYS) for b in _KEYS[i + 1:]]
O["interactions"] = q(cols(*[f"{a} * {b} AS {a}_x_{b}, {div(a, b)} AS {a}_div_{b}" for a, b in _pairs],
                           "CAST(coalesce(rsi > 70 OR rsi < 30, false) AS INTEGER) * volume_ratio AS rsi_volume_strength"),
                      "r5", _INTER)

# ---- relative family (rbars = bars + as-of weekday benchmark) -----------------------------------
_RET = ("x1", "rbars", f"{pct('close')} AS s, {pct('bclose')} AS b")
_EX = ("x2", "x1", "s - b AS ex")


def rq(select: str, src: str, *stages) -> str:
    return q(select, src, _stages(*stages), rel=True)


O["index_ratio"] = rq(f"sir AS stock_index_ratio, {pct('sir')} AS stock_index_ratio_change", "i1",
                      ("i1", "rbars", f"{div('close', 'bclose')} AS sir"))
O["excess_return"] = rq(cols("s - b AS excess_return_1d", *[
    f"{pct('close', p)} - {pct('bclose', p)} AS excess_return_{p}d, ({div(pct('close', p), pct('bclose', p))} - 1) AS relative_return_{p}d"
    for p in (5, 10, 20, 60)]), "x1", _RET)
O["relative_volatility"] = rq(cols(*[f"{div(std('s', p), std('b', p))} AS relative_volatility_{p}d" for p in (20, 60)]), "x1", _RET)
O["rolling_beta"] = rq(cols(*[f"{div(cov('s', 'b', p), roll('var_samp', 'b', p))} AS beta_{p}d" for p in (60, 120, 252)]), "x1", _RET)
O["rolling_corr"] = rq(cols(*[f"{corr('s', 'b', p)} AS correlation_{p}d" for p in (30, 60, 120)]), "x1", _RET)
O["relative_strength"] = rq(cols(*[
    f"{div(div('close', sma('close', p)), div('bclose', sma('bclose', p)))} AS relative_strength_{p}d, "
    f"{div(div('close', sma('close', p)), div('bclose', sma('bclose', p)))} AS relative_ma_{p}d" for p in (20, 50)]), "x1", _RET)
O["volume_vs_index"] = rq(f"{div('volume', 'bvolume')} AS volume_ratio_vs_index", "x1", _RET)
_W = [("w1", "rbars", f"{div('close', 'bclose')} AS pr"),
      ("w2", "w1", f"{sma('pr', 252)} AS rho"),
      ("w3", "w2", f"{div('rho', roll('sum', 'rho', 252))} AS estimated_index_weight"),
      ("w4", "w3", f"{pct('close')} AS s, {pct('bclose')} AS b")]
O["index_weight"] = rq("estimated_index_weight, volume * estimated_index_weight AS weight_adjusted_volume", "w3", *_W[:3])
O["volume_participation"] = rq(f"{div('sp', 'ip')} AS volume_participation_ratio, CAST(coalesce(sp > ip, false) AS INTEGER) AS volume_leadership",
                               "u1", ("u1", "rbars", f"{div('volume', sma('volume', 20))} AS sp, {div('bvolume', sma('bvolume', 20))} AS ip"))
O["volume_spike"] = rq(cols(*[f"{corr(f'zs{p}', f'zb{p}', p)} AS volume_spike_correlation_{p}d, zs{p} - zb{p} AS volume_leadership_strength_{p}d"
                              for p in (5, 20, 60)]), "z1",
                       ("z1", "rbars", cols(*[f"{div('volume - ' + sma('volume', p), std('volume', p))} AS zs{p}, "
                                              f"{div('bvolume - ' + sma('bvolume', p), std('bvolume', p))} AS zb{p}" for p in (5, 20, 60)])))
O["vw_excess_return"] = rq(f"s * {div('volume', sma('volume', 20))} - b * {div('bvolume', sma('bvolume', 20))} AS volume_weighted_excess_return",
                           "x1", _RET)
O["vw_correlation"] = rq(cols(*[f"{corr(f'sw{p}', 'b', p)} AS volume_weighted_correlation_{p}d" for p in (20, 60)]), "y3", _RET,
                         ("y2", "x1", cols(*[f"{div('volume', sma('volume', p))} AS vr{p}" for p in (20, 60)])),
                         ("y3", "y2", cols(*[f"s * (CASE WHEN vr{p} IS NOT NULL THEN least(greatest(vr{p}, 0.0), 3.0) END) AS sw{p}" for p in (20, 60)])))


def _q80(p: int) -> str:
    return f"(CASE WHEN count(volume) OVER {frame(p)} = {p} THEN quantile_cont(volume, 0.8) OVER {frame(p)} END)"


O["high_volume_corr"] = rq(cols(*[f"CASE WHEN m{p} THEN {corr('s', 'b', p, part=f'PARTITION BY ticker, m{p} ORDER BY date')} END "
                                  f"AS high_volume_price_correlation_{p}d" for p in (20, 60)]), "h1", _RET,
                           ("h1", "x1", cols(*[f"coalesce(volume > {_q80(p)}, false) AS m{p}" for p in (20, 60)])))
O["relative_momentum"] = rq(cols(*[f"({div(div('close', lag('close', p)), div('bclose', lag('bclose', p)))} - 1) AS relative_momentum_{p}d"
                                   for p in (10, 20, 50)]), "x1", _RET)
O["tracking_error"] = rq(cols(*[f"{std('ex', p)} AS tracking_error_{p}d" for p in (30, 60)]), "x2", _RET, _EX)
O["information_ratio"] = rq(cols(*[f"{div(sma('ex', p), std('ex', p))} AS information_ratio_{p}d" for p in (60, 120)]), "x2", _RET, _EX)
O["index_contribution"] = rq("s * estimated_index_weight AS estimated_index_contribution", "w4", *_W)
O["variance_explained"] = rq(cols(*[f"{div(cov('s', 'b', p) + ' * estimated_index_weight', roll('var_samp', 'b', p))} AS index_variance_explained_{p}d"
                                    for p in (30, 90)]), "w4", *_W)
O["cum_excess"] = rq(f"trailing_excess, {running('+', 'trailing_excess')} AS cum_excess", "c1",
                     ("c1", "rbars", f"{pct('close', 5)} - {pct('bclose', 5)} AS trailing_excess"))



def _engineered() -> tuple[list[str], str]:
    """Names of the engineered columns and CTEs that end in ``feats``: every family query without its rounding, joined
    on (ticker, date); of two columns of one name the first stays."""
    from barlens.plans.feature_queries import ENGINEERED, QUERIES

    names: list[str] = []
    ctes, joins = "", []
    for k, name in enumerate(ENGINEERED):
        body = O[name][len(RB):] if O[name].startswith(RB) else O[name][len(B):]
        body = body.replace("round(COLUMNS(* EXCLUDE (ticker, date)), 6)", "COLUMNS(* EXCLUDE (ticker, date))")
        body = "WITH " + body[1:] if body.startswith(",") else body
        own = [c for c in QUERIES[name].cols if c not in names]
        names += own
        ctes += f",\nq{k} AS MATERIALIZED (SELECT ticker, date, {', '.join(own)} FROM ({body}))"
        joins.append(f"q{k}" if not k else f"JOIN q{k} USING (ticker, date)")
    return names, ctes + f",\nfeats AS (SELECT ticker, date, {', '.join(names)} FROM {' '.join(joins)})"


ENGINEERED_COLS, ENGINEERED_CTES = _engineered()
_BASE = RB.replace("bars AS (", "bars AS MATERIALIZED (", 1).replace("market AS (", "market AS MATERIALIZED (", 1)
FEATS = _BASE + ENGINEERED_CTES
_ALL = "COLUMNS(* EXCLUDE (ticker, date))"
O["feature_merge"] = FEATS + f""",
filled AS (SELECT ticker, date, {', '.join(f'first_value({c} IGNORE NULLS) OVER w AS {c}' for c in ENGINEERED_COLS)} FROM feats
           WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
stats AS (SELECT ticker, {', '.join(f'avg(CAST({c} IS NULL AS DOUBLE)) AS n_{c}, median({c}) AS m_{c}' for c in ENGINEERED_COLS)} FROM filled GROUP BY ticker)
""" + rounded("SELECT filled.ticker, date, " + ", ".join(f"CASE WHEN n_{c} <= 0.5 THEN coalesce({c}, m_{c}) END AS {c}" for c in ENGINEERED_COLS)
              + " FROM filled JOIN stats USING (ticker)")

ORACLE = O
