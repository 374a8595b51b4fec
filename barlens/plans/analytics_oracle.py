"""DuckDB oracle SQL for the analytics queries (reports, selection, metrics, registry)."""

from __future__ import annotations

from barlens.plans.core_oracle import BBM, BTM, LABELS_CTES, SECTOR_CTE
from barlens.plans.feature_oracle import ENGINEERED_COLS, FEATS
from barlens.plans.sqlkit import BARS_CTE, MARKET_CTE, rounded, sma, std, with_ctes

P = "PARTITION BY ticker ORDER BY date"
FEATURES = ["momentum_20", "rs_sma_20", "price_ma_position_20", "price_zscore_20", "volume_ratio", "volatility_20"]
SIGNALS = ["momentum_20", "rs_sma_20", "price_zscore_20", "volume_ratio", "volatility_20"]

_S20 = sma("close", 20)
_SIG = f"""sig0 AS (SELECT ticker, date, close, volume,
    close / nullif(lag(close, 20) OVER ({P}), 0) - 1 AS momentum_20,
    (close - {_S20}) / nullif({_S20}, 0) AS rs_sma_20,
    (close - {_S20}) / nullif({_S20}, 0) AS price_ma_position_20,
    (close - {_S20}) / nullif({std('close', 20)}, 0) AS price_zscore_20,
    volume / nullif({sma('volume', 20)}, 0) AS volume_ratio,
    close / nullif(lag(close) OVER ({P}), 0) - 1 AS r_
  FROM bars),
sig1 AS (SELECT * EXCLUDE (r_), {std('r_', 20)} AS volatility_20 FROM sig0)"""
SIGNALS_SQL = with_ctes(BARS_CTE) + ",\n" + _SIG
FRAME = BTM + LABELS_CTES + ",\n" + _SIG + """,
fl AS (SELECT sig1.*, lab.stock_return, lab.benchmark_return, lab.excess_return, lab.outperforms
       FROM sig1 JOIN lab ON sig1.ticker = lab.ticker AND sig1.date = lab.date),
pos AS (SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS row_pos, count(*) OVER () AS n_all FROM fl),
frame AS (SELECT * EXCLUDE (n_all),
  CASE WHEN row_pos < floor(floor(n_all * CAST(0.8 AS DOUBLE)) * CAST(0.8 AS DOUBLE)) THEN 'train'
       WHEN row_pos < floor(n_all * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM pos)"""


def _long(src: str, feats=FEATURES, extra: str = "") -> str:
    """Unpivot features of ``src`` to (ticker, date, [extra,] feature, value)."""
    ex = f", {extra}" if extra else ""
    return "\nUNION ALL ".join(f"SELECT ticker, date{ex}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src}" for f in feats)


def _corr(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


O: dict[str, str] = {}

# ---- reports
TE = BTM + f""",
s AS (SELECT ticker, date, close / nullif(lag(close, 5) OVER ({P}), 0) - 1 AS stock_return FROM bars),
b AS (SELECT date, close / nullif(lag(close, 5) OVER (ORDER BY date), 0) - 1 AS benchmark_return FROM market),
te0 AS (SELECT s.ticker, s.date, stock_return, benchmark_return FROM s JOIN b ON s.date = b.date WHERE stock_return IS NOT NULL),
te AS (SELECT *, stock_return - benchmark_return AS excess_return,
         CAST(coalesce(stock_return - benchmark_return > 0, false) AS INTEGER) AS outperforms
       FROM te0 WHERE ticker IN (SELECT ticker FROM te0 GROUP BY ticker HAVING count(*) >= 50))"""
O["risk_return"] = TE + "\n" + rounded(
    "SELECT ticker, round(avg(stock_return), 4) AS mean_return, round(stddev_samp(stock_return), 4) AS volatility, "
    "round(avg(outperforms), 4) AS outperf_rate FROM te GROUP BY ticker", keep="ticker")
O["box_stats"] = TE + "\n" + rounded(
    "SELECT ticker, count(stock_return) AS n, min(stock_return) AS min, quantile_cont(stock_return, 0.25) AS q1, "
    "quantile_cont(stock_return, 0.5) AS median, quantile_cont(stock_return, 0.75) AS q3, max(stock_return) AS max FROM te GROUP BY ticker",
    keep="ticker, n")

AR = BBM + f""",
nb AS (SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 252)),
s AS (SELECT ticker, date, close / nullif(lag(close) OVER ({P}), 0) - 1 AS s FROM nb),
b AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS b FROM market),
j AS (SELECT s.ticker, s.date, s.s, b.b FROM s JOIN b ON s.date = b.date WHERE s.s IS NOT NULL AND b.b IS NOT NULL),
g AS (SELECT ticker, count(*) AS n_aligned, avg(s) * 252 AS annual_return, stddev_samp(s) * sqrt(252) AS volatility,
             avg(b) * 252 AS bench_return, covar_samp(s, b) AS cv, var_pop(b) AS vb
      FROM j GROUP BY ticker HAVING count(*) >= 100),
g2 AS (SELECT *, CASE WHEN vb > 0 THEN cv / vb ELSE 0.0 END AS beta,
              CASE WHEN volatility > 0 THEN (annual_return - 0.02) / volatility ELSE 0.0 END AS sharpe_ratio FROM g),
ar AS (SELECT ticker, n_aligned, annual_return, volatility, sharpe_ratio, beta,
              annual_return - (0.02 + beta * (bench_return - 0.02)) AS alpha FROM g2)"""
O["annual_risk"] = AR + "\n" + rounded("SELECT * FROM ar", keep="ticker, n_aligned")
O["top_sharpe"] = AR + "\n" + rounded("SELECT ticker, sharpe_ratio FROM ar ORDER BY sharpe_ratio DESC, ticker LIMIT 5", keep="ticker")
O["histogram"] = AR + f""",
top AS (SELECT ticker FROM ar ORDER BY sharpe_ratio DESC, ticker LIMIT 5),
r AS (SELECT * FROM (SELECT ticker, date, close / nullif(lag(close) OVER ({P}), 0) - 1 AS r FROM bars)
      WHERE ticker IN (SELECT ticker FROM top) AND r IS NOT NULL),
r2 AS (SELECT *, min(r) OVER (PARTITION BY ticker) AS lo, max(r) OVER (PARTITION BY ticker) AS hi FROM r),
r3 AS (SELECT ticker, CAST(least(coalesce(floor((r - lo) / nullif((hi - lo) / 50, 0)), 0), 49) AS INTEGER) AS bin FROM r2),
bins AS (SELECT ticker, lo, hi, CAST(unnest(range(50)) AS INTEGER) AS bin FROM (SELECT DISTINCT ticker, lo, hi FROM r2))
""" + rounded("SELECT b.ticker, b.bin, lo + b.bin * (hi - lo) / 50 AS bin_start, count(r3.bin) AS count "
              "FROM bins b LEFT JOIN r3 ON b.ticker = r3.ticker AND b.bin = r3.bin GROUP BY b.ticker, b.bin, lo, hi",
              keep="ticker, bin, count")
O["max_drawdown"] = BB_DD = with_ctes(BARS_CTE, ticker="p_brand") + f""",
c AS (SELECT ticker, date, close / first_value(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_growth FROM bars),
d AS (SELECT *, (cum_growth / max(cum_growth) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1.0) * 100.0 AS drawdown_pct FROM c)
""" + rounded("SELECT ticker, min(drawdown_pct) AS max_drawdown, max(cum_growth) AS peak_growth FROM d GROUP BY ticker", keep="ticker")
TP = with_ctes(SECTOR_CTE) + f""",
dd AS (SELECT ticker, min(dpct) AS max_drawdown FROM (
   SELECT ticker, (cg / max(cg) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1.0) * 100.0 AS dpct FROM (
     SELECT ticker, date, close / first_value(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cg FROM sbars))
   GROUP BY ticker),
rr AS (SELECT ticker, date, close, close / nullif(lag(close) OVER ({P}), 0) - 1 AS r FROM sbars),
g AS (SELECT ticker, count(*) AS n, (arg_max(close, date) / arg_min(close, date) - 1.0) * 100.0 AS total_return,
             stddev_samp(r) * sqrt(252) * 100.0 AS volatility FROM rr GROUP BY ticker HAVING count(*) >= 100),
tp AS (SELECT g.ticker, total_return, volatility, max_drawdown,
              CASE WHEN volatility > 0 THEN total_return / volatility ELSE 0.0 END AS sharpe_ratio FROM g JOIN dd ON g.ticker = dd.ticker)"""
O["ticker_performance"] = TP + "\n" + rounded("SELECT * FROM tp", keep="ticker")
O["sector_performance"] = TP + """,
dim AS (SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)
""" + rounded("""SELECT coalesce(dim.sector, 'Other') AS sector, avg(total_return) AS avg_return, avg(volatility) AS avg_volatility,
  avg(sharpe_ratio) AS avg_sharpe, count(*) AS count FROM tp LEFT JOIN dim ON tp.ticker = dim.ticker GROUP BY 1""", keep="sector, count")
O["return_corr_matrix"] = BTM + """,
allser AS (SELECT ticker, date, close FROM bars UNION ALL SELECT 'SPY', date, close FROM market),
nser AS (SELECT count(DISTINCT ticker) AS n FROM allser),
ords AS (SELECT ticker, row_number() OVER (ORDER BY ticker = 'SPY', ticker) AS o FROM (SELECT DISTINCT ticker FROM allser)),
full_dates AS (SELECT date FROM allser WHERE close IS NOT NULL GROUP BY date HAVING count(*) = (SELECT n FROM nser)),
rets AS (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r
         FROM allser WHERE date IN (SELECT date FROM full_dates)),
rdates AS (SELECT date FROM rets GROUP BY date HAVING count(r) = (SELECT n FROM nser)),
r2 AS (SELECT rets.*, ords.o FROM rets JOIN ords ON rets.ticker = ords.ticker WHERE date IN (SELECT date FROM rdates)),
pairs AS (SELECT x.ticker AS a, y.ticker AS b, """ + _corr("x.r", "y.r") + """ AS corr
          FROM r2 x JOIN r2 y ON x.date = y.date AND x.o < y.o GROUP BY 1, 2)
""" + rounded("SELECT a, b, corr, abs(corr) >= 0.6 AS edge FROM pairs", keep="a, b, edge")
O["rolling_vol_report"] = BTM + f""",
s AS (SELECT ticker, date, close / nullif(lag(close) OVER ({P}), 0) - 1 AS r FROM bars),
s2 AS (SELECT ticker, {std('r', 20)} * sqrt(252) * 100.0 AS vol FROM s),
b AS (SELECT 'market' AS ticker, date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS r FROM market),
b2 AS (SELECT ticker, {std('r', 20, 'PARTITION BY ticker ORDER BY date')} * sqrt(252) * 100.0 AS vol FROM b),
u AS (SELECT * FROM s2 UNION ALL SELECT * FROM b2)
""" + rounded("SELECT ticker, avg(vol) AS avg_volatility, count(*) AS n FROM u WHERE vol IS NOT NULL GROUP BY ticker", keep="ticker, n")

# the engineered table with labels and split, and the same as (r, feature, ordinal, value) rows
WIDE = FEATS + LABELS_CTES + """,
fl AS (SELECT feats.*, lab.outperforms FROM feats JOIN lab ON feats.ticker = lab.ticker AND feats.date = lab.date),
pos AS (SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS row_pos, count(*) OVER () AS n_all FROM fl),
frame AS MATERIALIZED (SELECT * EXCLUDE (n_all),
  CASE WHEN row_pos < floor(floor(n_all * CAST(0.8 AS DOUBLE)) * CAST(0.8 AS DOUBLE)) THEN 'train'
       WHEN row_pos < floor(n_all * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM pos),
train AS MATERIALIZED (SELECT * FROM frame WHERE split = 'train')"""


def _wide_long(src: str, cols=(*ENGINEERED_COLS, "outperforms")) -> str:
    names = ", ".join(f"'{c}'" for c in cols)
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in cols)
    return (f",\ntl AS MATERIALIZED (SELECT row_pos AS r, split, outperforms, unnest([{names}]) AS feature, unnest(range({len(cols)})) AS ordinal, "
            f"unnest([{values}]) AS value FROM {src})")


def _target(src: str, n: int) -> str:
    return _wide_long(src) + f""",
tc AS (SELECT feature, any_value(ordinal) AS ordinal, {_corr("value", "CAST(outperforms AS DOUBLE)")} AS corr FROM tl WHERE value IS NOT NULL AND feature <> 'outperforms' GROUP BY feature),
top AS (SELECT * FROM tc ORDER BY round(abs(corr), 9) DESC NULLS LAST, feature LIMIT {n})"""


_PAIRS = f"""pairs AS (SELECT x.feature AS a, y.feature AS b, {_corr("x.value", "y.value")} AS corr
          FROM lo x JOIN lo y ON x.r = y.r AND x.ordinal < y.ordinal GROUP BY 1, 2)"""
O["top_features"] = WIDE + _target("train", 20) + "\n" + rounded("SELECT feature, corr, abs(corr) AS abs_corr FROM top", keep="feature")
O["feature_corr_matrix"] = WIDE + _target("frame", 25) + f""",
lo AS (SELECT * FROM tl WHERE value IS NOT NULL AND feature IN (SELECT feature FROM top UNION ALL SELECT 'outperforms')),
{_PAIRS}
""" + rounded("SELECT * FROM pairs", keep="a, b")

# ---- selection / preparation
TRAIN = FRAME + ",\ntrain AS (SELECT * FROM frame WHERE split = 'train')"
_FEATURE_LONG = _wide_long("train", ENGINEERED_COLS)
O["corr_prune"] = WIDE + _FEATURE_LONG + f""",
nr AS (SELECT feature, any_value(ordinal) AS ordinal, avg(CAST(value IS NULL AS INTEGER)) AS null_ratio FROM tl GROUP BY feature),
lo AS (SELECT * FROM tl WHERE value IS NOT NULL AND feature IN (SELECT feature FROM nr WHERE null_ratio < 0.5)),
{_PAIRS},
worst AS (SELECT b AS feature, max(abs(corr)) AS max_abs_corr_prior FROM pairs GROUP BY b)
SELECT nr.feature, CAST(nr.ordinal AS INTEGER) AS ordinal, round(nr.null_ratio, 6) AS null_ratio,
       round(worst.max_abs_corr_prior, 6) AS max_abs_corr_prior,
       nr.null_ratio < 0.5 AND coalesce(worst.max_abs_corr_prior <= 0.95, true) AS keep
FROM nr LEFT JOIN worst ON nr.feature = worst.feature"""
_FSC = WIDE + _FEATURE_LONG + """,
g AS (SELECT feature, outperforms, count(*) AS n_g, avg(value) AS m_g, var_pop(value) AS v_g FROM tl WHERE value IS NOT NULL GROUP BY 1, 2),
g2 AS (SELECT *, sum(n_g) OVER (PARTITION BY feature) AS n, sum(n_g * m_g) OVER (PARTITION BY feature) / sum(n_g) OVER (PARTITION BY feature) AS m,
              count(*) OVER (PARTITION BY feature) AS k FROM g),
a AS (SELECT feature, CAST(n AS BIGINT) AS n, k, sum(n_g * ((m_g - m) * (m_g - m))) AS ssb, sum(n_g * v_g) AS ssw FROM g2 GROUP BY feature, n, k),
fsc AS (SELECT feature, n, (ssb / nullif(k - 1, 0)) / nullif(ssw / nullif(n - k, 0), 0) AS f_score FROM a)
"""
O["f_score"] = _FSC + rounded("SELECT * FROM fsc", keep="feature, n")
O["f_score_top"] = _FSC + rounded("SELECT * FROM fsc ORDER BY round(f_score, 9) DESC NULLS LAST, feature LIMIT 50", keep="feature, n")
_MI = """j AS (SELECT feature, bin, outperforms, count(*) AS n_xy FROM b GROUP BY ALL),
t AS (SELECT *, sum(n_xy) OVER (PARTITION BY feature) AS n, sum(n_xy) OVER (PARTITION BY feature, bin) AS n_x,
             sum(n_xy) OVER (PARTITION BY feature, outperforms) AS n_y FROM j),
mi AS (SELECT feature, sum((n_xy / n) * ln((n_xy * n) / (n_x * n_y))) AS mutual_info FROM t GROUP BY feature)
"""
O["mutual_info_ntile"] = TRAIN + f""",
tl AS ({_long('train', extra='outperforms')}),
b AS (SELECT feature, outperforms, ntile(10) OVER (PARTITION BY feature ORDER BY value, ticker, date) AS bin FROM tl WHERE value IS NOT NULL),
""" + _MI + rounded("SELECT * FROM mi", keep="feature")
_BINNED = WIDE + _FEATURE_LONG + """,
sorted AS (SELECT feature, list_sort(list(value)) AS s FROM tl WHERE value IS NOT NULL GROUP BY feature),
bounds AS (SELECT feature, list_transform(range(1, 10), lambda k: s[(len(s) - 1) * k // 10 + 1]) AS bs FROM sorted),
b AS (SELECT tl.feature, outperforms, len(list_filter(bs, lambda q: q < value)) AS bin FROM tl JOIN bounds ON tl.feature = bounds.feature WHERE value IS NOT NULL),
""" + _MI
O["mutual_info"] = _BINNED + rounded("SELECT * FROM mi", keep="feature")
O["mutual_info_top"] = _BINNED + rounded("SELECT * FROM mi ORDER BY round(mutual_info, 9) DESC NULLS LAST, feature LIMIT 50", keep="feature")
_STATS = ", ".join(f"avg({f}) AS mu_{f}, stddev_pop({f}) AS sd_{f}" for f in FEATURES)
O["standardize"] = FRAME + f""",
st AS (SELECT {_STATS} FROM frame WHERE split = 'train')
""" + rounded("SELECT ticker, date, split, " + ", ".join(
    f"({f} - mu_{f}) / (CASE WHEN sd_{f} = 0 THEN 1.0 ELSE sd_{f} END) AS {f}" for f in FEATURES) + " FROM frame, st",
    keep="ticker, date, split")
O["feature_null_ratio"] = FRAME + f""",
tl AS ({_long('frame')})
""" + rounded("SELECT ticker, feature, avg(CAST(value IS NULL AS DOUBLE)) AS null_ratio FROM tl GROUP BY ticker, feature",
              keep="ticker, feature")
O["bfill_features"] = FRAME + "\n" + rounded("SELECT ticker, date, " + ", ".join(
    f"first_value({f} IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {f}" for f in FEATURES) + " FROM frame")
O["median_impute"] = FRAME + "\n" + rounded("SELECT ticker, date, " + ", ".join(
    f"coalesce({f}, median({f}) OVER (PARTITION BY ticker)) AS {f}" for f in FEATURES) + " FROM frame")
_SP = "PARTITION BY ticker"
O["drop_sparse_features"] = FRAME + """,
d AS (SELECT ticker, date, momentum_20, CASE WHEN isodow(date) >= 6 THEN close END AS weekend_close,
             CASE WHEN split = 'test' THEN close END AS test_close FROM frame)
""" + rounded("SELECT ticker, date, " + ", ".join(
    f"CASE WHEN avg(CAST({c} IS NULL AS DOUBLE)) OVER ({_SP}) <= 0.5 THEN {c} END AS {c}"
    for c in ("momentum_20", "weekend_close", "test_close")) + " FROM d")
O["inf_to_null"] = FRAME + "\n" + rounded("SELECT ticker, date, " + ", ".join(
    f"CASE WHEN isinf({f}) OR isnan({f}) THEN NULL ELSE {f} END AS {f}" for f in FEATURES) + " FROM frame")
O["quality_report"] = WIDE + _wide_long("frame", ENGINEERED_COLS) + """,
qr AS (SELECT feature, avg(CAST(value IS NULL AS DOUBLE)) AS null_ratio, CAST(coalesce(sum(CAST(isinf(value) AS INTEGER)), 0) AS BIGINT) AS inf_count
      FROM tl GROUP BY feature),
ln AS (SELECT CAST(sum(CAST(outperforms IS NULL AS INTEGER)) AS BIGINT) AS label_nulls FROM frame),
qp AS (SELECT qr.*, ln.label_nulls, null_ratio > 0.5 OR inf_count > 0 AS is_problem FROM qr, ln)
""" + rounded("SELECT feature, null_ratio, inf_count, label_nulls, is_problem, "
              "(count(*) OVER () - sum(CAST(is_problem AS INTEGER)) OVER ()) / count(*) OVER () AS quality_score, "
              "label_nulls = 0 AS labels_ok FROM qp", keep="feature, inf_count, label_nulls, is_problem, labels_ok")
O["prepare_matrix"] = WIDE + ",\nmed AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in ENGINEERED_COLS) + " FROM train)\nSELECT " + ", ".join(
    f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in ENGINEERED_COLS) + " FROM train, med"
O["align_feature_columns"] = FRAME + ",\nt AS (SELECT * FROM frame WHERE split = 'test')\n" + rounded(
    "SELECT ticker, date, " + ", ".join(f"coalesce(CAST({f} AS DOUBLE), (SELECT median({f}) FROM t), 0.0) AS {f}" if f != "adx_14"
                                        else "0.0::DOUBLE AS adx_14" for f in ["volatility_20", "momentum_20", "adx_14", "rs_sma_20"])
    + " FROM t")

# ---- metrics
SCORED = FRAME + """,
sc0 AS (SELECT ticker, date, split, rs_sma_20 AS score, outperforms AS label, CAST(rs_sma_20 > 0 AS INTEGER) AS pred,
               0.5 + 0.5 * (rs_sma_20 * 10.0) / (1.0 + abs(rs_sma_20 * 10.0)) AS prob
        FROM frame WHERE rs_sma_20 IS NOT NULL)"""


def _auc(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    gb = f"GROUP BY {keys}" if keys else ""
    return f"""sc AS (SELECT {k}score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM {src} GROUP BY {k}score),
cu AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_neg FROM sc),
au AS (SELECT {k}sum(CAST(pos AS DOUBLE) * (CAST(cum_neg AS DOUBLE) + CAST(neg AS DOUBLE) / 2.0))
            / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc,
           CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM cu {gb})"""


def _cm(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    gb = f"GROUP BY {keys}" if keys else ""
    return f"""cm0 AS (SELECT {k}count(*) AS n, CAST(sum(CAST(pred = label AS INTEGER)) AS BIGINT) AS correct,
        CAST(sum(CAST(pred = 1 AND label = 1 AS INTEGER)) AS BIGINT) AS tp, CAST(sum(CAST(pred = 1 AND label = 0 AS INTEGER)) AS BIGINT) AS fp,
        CAST(sum(CAST(pred = 0 AND label = 1 AS INTEGER)) AS BIGINT) AS fn FROM {src} {gb}),
cm1 AS (SELECT *, correct / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
        coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM cm0),
cm AS (SELECT *, coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score FROM cm1)"""


O["roc_auc"] = SCORED + ",\n" + _auc("sc0") + "\n" + rounded("SELECT * FROM au", keep="n_pos, n_neg")
O["class_metrics"] = SCORED + ",\nts AS (SELECT * FROM sc0 WHERE split = 'test'),\n" + _cm("ts") + "\n" + rounded(
    "SELECT * FROM cm", keep="n, correct, tp, fp, fn")
_PR = SCORED + """,
ts AS (SELECT * FROM sc0 WHERE split = 'test'),
sc AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM ts GROUP BY score),
cu AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cp,
              coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn,
              sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc),
pr AS (SELECT score AS threshold, CAST(P - cp AS BIGINT) AS tp, CAST(N - cn AS BIGINT) AS fp,
              coalesce(CAST(P - cp AS DOUBLE) / nullif(CAST(P - cp + N - cn AS DOUBLE), 0), 0.0) AS precision,
              CAST(P - cp AS DOUBLE) / nullif(CAST(P AS DOUBLE), 0) AS recall FROM cu)"""
O["pr_curve"] = _PR + "\n" + rounded("SELECT * FROM pr", keep="tp, fp")
O["avg_precision"] = _PR + "\nSELECT round((sum(precision) + 1.0) / (count(*) + 1), 6) AS avg_precision FROM pr"
O["calibration"] = SCORED + """,
c AS (SELECT abs(prob - 0.5) * 2.0 AS confidence, CAST(CAST(prob > 0.5 AS INTEGER) = label AS DOUBLE) AS hit FROM sc0 WHERE split = 'test'),
c2 AS (SELECT *, CAST(""" + " + ".join(f"CAST(confidence >= CAST({i / 10!r} AS DOUBLE) AS INTEGER)" for i in range(1, 10)) + """ AS INTEGER) AS bin
       FROM c WHERE confidence < 1.0)
""" + rounded("SELECT bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(hit) AS accuracy FROM c2 GROUP BY bin", keep="bin, n")
O["histogram_probs"] = SCORED + """,
h AS (SELECT prob, min(prob) OVER () AS lo, max(prob) OVER () AS hi FROM sc0 WHERE split = 'test' AND prob IS NOT NULL),
h2 AS (SELECT CAST(least(coalesce(floor((prob - lo) / nullif((hi - lo) / 30, 0)), 0), 29) AS INTEGER) AS bin FROM h),
bins AS (SELECT lo, hi, CAST(unnest(range(30)) AS INTEGER) AS bin FROM (SELECT DISTINCT lo, hi FROM h))
""" + rounded("SELECT b.bin, lo + b.bin * (hi - lo) / 30 AS bin_start, count(h2.bin) AS count "
              "FROM bins b LEFT JOIN h2 ON b.bin = h2.bin GROUP BY b.bin, lo, hi", keep="bin, count")
O["validate_predictions"] = SCORED + """
SELECT ticker, date, pred AS predicted, label AS actual, pred = label AS correct FROM sc0 WHERE split = 'test'"""
O["top_predictions"] = with_ctes(BARS_CTE, ticker="p_brand") + f""",
t AS (SELECT ticker, date, close, (close - {_S20}) / nullif({_S20}, 0) AS rs FROM bars),
l AS (SELECT * FROM t WHERE rs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
p AS (SELECT ticker, date AS prediction_date, 0.5 + 0.5 * (rs * 10.0) / (1.0 + abs(rs * 10.0)) AS outperform_probability,
             close AS last_price FROM l),
p2 AS (SELECT *, outperform_probability > 0.5 AS prediction, greatest(outperform_probability, 1 - outperform_probability) AS confidence FROM p)
""" + rounded("SELECT * FROM p2 WHERE prediction AND confidence >= 0.55 ORDER BY outperform_probability DESC, ticker LIMIT 50",
              keep="ticker, prediction_date, prediction")
O["ks_drift"] = WIDE + ",\ntt AS (SELECT * FROM frame WHERE split IN ('train', 'test'))" + _wide_long("tt", ENGINEERED_COLS) + """,
tl2 AS (SELECT feature, value, CAST(split = 'test' AS INTEGER) AS sample FROM tl),
c AS (SELECT feature, value, CAST(sum(CAST(sample = 0 AS INTEGER)) AS BIGINT) AS c0, CAST(sum(CAST(sample = 1 AS INTEGER)) AS BIGINT) AS c1
      FROM tl2 WHERE value IS NOT NULL GROUP BY feature, value),
cu AS (SELECT *, sum(c0) OVER w AS k0, sum(c1) OVER w AS k1, sum(c0) OVER (PARTITION BY feature) AS n0, sum(c1) OVER (PARTITION BY feature) AS n1
       FROM c WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT feature, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, max(abs(k0 / n0 - k1 / n1)) AS ks_stat FROM cu GROUP BY ALL),
s2 AS (SELECT *, CAST(n0 * n1 AS DOUBLE) / CAST(n0 + n1 AS DOUBLE) AS ne FROM s),
s3 AS (SELECT *, (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * ks_stat AS lam FROM s2),
s4 AS (SELECT feature, n0, n1, ks_stat, least(greatest(CASE WHEN lam <= 0 THEN 1.0
          WHEN lam < 1.18 THEN 1.0 - sqrt(2.0 * pi()) / lam * list_reduce(list_transform(range(1, 101),
            lambda k: exp(-((2 * k - 1) * (2 * k - 1)) * (pi() * pi()) / (8.0 * lam * lam))), lambda a, v: a + v, CAST(0.0 AS DOUBLE))
          ELSE 2.0 * list_reduce(list_transform(range(1, 101),
            lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)), lambda a, v: a + v, CAST(0.0 AS DOUBLE)) END, 0.0), 1.0) AS p_value FROM s3)
""" + rounded("SELECT *, p_value < 0.05 AS drift FROM s4", keep="feature, n0, n1, drift")

# ---- registry / leaderboards
_SIG_STRUCTS = ", ".join(f"{{'model_name': '{s}', 'score': CAST({s} AS DOUBLE)}}" for s in SIGNALS)
REG = FRAME + f""",
uni AS (SELECT row_number() OVER (ORDER BY ticker) AS ordinal, ticker FROM (SELECT DISTINCT p_type AS ticker FROM part)),
lg0 AS (SELECT f.ticker, f.date, f.split, u.ordinal, f.outperforms AS label, unnest([{_SIG_STRUCTS}]) AS sg
        FROM frame f JOIN uni u ON f.ticker = u.ticker),
lg1 AS (SELECT *, unnest(list_filter([2, 4, 6], lambda n: n >= ordinal)) AS stocks_count FROM lg0),
lg AS (SELECT sg.model_name AS model_name, stocks_count, ticker, date, split, sg.score AS score, label,
              CAST(sg.score > 0 AS INTEGER) AS pred FROM lg1 WHERE sg.score IS NOT NULL),
te AS (SELECT * FROM lg WHERE split = 'test'),
{_auc('te', 'model_name, stocks_count')},
{_cm('te', 'model_name, stocks_count')},
trn AS (SELECT model_name, stocks_count, count(*) AS training_samples FROM lg WHERE split = 'train' GROUP BY ALL),
reg AS (SELECT au.model_name || '_' || CAST(au.stocks_count AS VARCHAR) || 'stocks_v1.model' AS file_name, au.model_name,
               au.stocks_count, printf('2024-01-%02d %02d:00:00', au.stocks_count, length(au.model_name)) AS timestamp,
               1 AS feature_count, au.auc, cm.accuracy, cm.precision, cm.recall, cm.f1_score, trn.training_samples
        FROM au JOIN cm ON au.model_name = cm.model_name AND au.stocks_count = cm.stocks_count
        LEFT JOIN trn ON au.model_name = trn.model_name AND au.stocks_count = trn.stocks_count)"""
_RK = "file_name, model_name, stocks_count, timestamp, feature_count, training_samples"
O["registry"] = REG + "\n" + rounded("SELECT * FROM reg", keep=_RK)
O["registry_scan"] = REG + "\n" + rounded(
    "SELECT file_name, regexp_extract(file_name, '(.+)_(\\d+)stocks_', 1) AS parsed_model, "
    "CAST(regexp_extract(file_name, '(.+)_(\\d+)stocks_', 2) AS INTEGER) AS parsed_stocks, "
    "coalesce(auc, 0.0) AS auc, coalesce(accuracy, 0.0) AS accuracy, coalesce(precision, 0.0) AS precision, "
    "coalesce(recall, 0.0) AS recall, coalesce(f1_score, 0.0) AS f1_score, training_samples FROM reg",
    keep="file_name, parsed_model, parsed_stocks, training_samples")
O["leaderboard_by_type"] = REG + "\n" + rounded(
    "SELECT model_name, count(*) AS runs, avg(auc) AS mean_auc, avg(accuracy) AS mean_accuracy, avg(precision) AS mean_precision, "
    "avg(recall) AS mean_recall FROM reg GROUP BY model_name", keep="model_name, runs")
_BEST = REG + ",\nbest AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY stocks_count ORDER BY auc DESC, model_name) = 1)"
O["best_per_group"] = _BEST + "\n" + rounded("SELECT * FROM best", keep=_RK)
O["best_model_counts"] = _BEST + "\nSELECT model_name, count(*) AS wins FROM best GROUP BY model_name"
O["scaling_report"] = _BEST + "\n" + rounded(
    "SELECT a.stocks_count, a.mean_auc, a.mean_accuracy, a.training_samples, b.model_name AS best_model, b.auc AS best_auc FROM "
    "(SELECT stocks_count, avg(auc) AS mean_auc, avg(accuracy) AS mean_accuracy, max(training_samples) AS training_samples "
    "FROM reg GROUP BY stocks_count) a JOIN best b ON a.stocks_count = b.stocks_count",
    keep="stocks_count, training_samples, best_model")
O["best_per_metric"] = REG + """,
m AS (SELECT model_name, stocks_count, unnest([{'metric': 'auc', 'score': auc}, {'metric': 'accuracy', 'score': accuracy},
        {'metric': 'precision', 'score': precision}, {'metric': 'recall', 'score': recall}, {'metric': 'f1_score', 'score': f1_score}]) AS m FROM reg),
m2 AS (SELECT model_name, stocks_count, m.metric AS metric, m.score AS score FROM m WHERE m.score > 0)
""" + rounded("SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY score DESC, model_name, stocks_count) = 1",
              keep="model_name, stocks_count, metric")
O["best_model"] = REG + ",\nrecent AS (SELECT * FROM reg)\n" + rounded(
    "SELECT * FROM recent ORDER BY auc DESC NULLS LAST, timestamp DESC, file_name LIMIT 1", keep=_RK)
O["latest_model"] = REG + "\n" + rounded("SELECT * FROM reg ORDER BY timestamp DESC, file_name LIMIT 3", keep=_RK)
O["perf_gate"] = REG + "\n" + rounded(
    "SELECT file_name, accuracy, auc, precision, accuracy < 0.55 OR auc < 0.60 OR precision < 0.55 AS needs_retrain FROM reg",
    keep="file_name, needs_retrain")

# ---- monitors
O["cache_compat"] = with_ctes(BARS_CTE, ticker="p_brand") + """,
c AS (SELECT * FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
r AS (SELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'),
s AS (SELECT (SELECT min(date) FROM c) AS c_start, (SELECT max(date) FROM c) AS c_end,
             (SELECT min(date) FROM r) AS r_start, (SELECT max(date) FROM r) AS r_end,
             (SELECT count(*) FROM (SELECT DISTINCT ticker FROM r EXCEPT SELECT DISTINCT ticker FROM c)) AS missing_tickers,
             (SELECT count(*) FROM (SELECT DISTINCT ticker FROM c EXCEPT SELECT DISTINCT ticker FROM r)) AS extra_tickers),
s2 AS (SELECT *, CAST(greatest(datediff('day', greatest(c_start, r_start), least(c_end, r_end)), 0) AS DOUBLE)
                 / nullif(CAST(datediff('day', c_start, c_end) AS DOUBLE), 0) AS overlap_ratio FROM s)
SELECT c_start, c_end, r_start, r_end, missing_tickers, extra_tickers, round(overlap_ratio, 6) AS overlap_ratio,
       missing_tickers = 0 AND extra_tickers = 0 AND coalesce(overlap_ratio >= 0.8, false) AS compatible FROM s2"""
O["source_quality"] = with_ctes(BARS_CTE, ticker="p_brand") + """,
nr AS (SELECT ticker, (sum(CAST(open IS NULL AS INTEGER)) + sum(CAST(high IS NULL AS INTEGER)) + sum(CAST(low IS NULL AS INTEGER))
        + sum(CAST(close IS NULL AS INTEGER)) + sum(CAST(volume IS NULL AS INTEGER))) / (count(*) * 5) AS null_ratio FROM bars GROUP BY ticker),
s AS (SELECT count(DISTINCT ticker) AS n_tickers, max(date) AS last_date FROM bars),
s2 AS (SELECT *, CAST(DATE '2001-11-05' - last_date AS INTEGER) AS stale_days, (SELECT max(null_ratio) FROM nr) AS worst_null_ratio FROM s)
SELECT n_tickers, last_date, stale_days, round(worst_null_ratio, 6) AS worst_null_ratio,
       n_tickers >= 20 AND stale_days <= 2 AND worst_null_ratio < 0.1 AS passed FROM s2"""

ORACLE = O
