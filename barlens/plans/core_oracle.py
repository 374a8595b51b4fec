"""DuckDB oracle SQL for the core queries (sources, cleansing, labels, joins, splits, sets)."""

from __future__ import annotations

from barlens.plans.sqlkit import BARS_CTE, GAPPY_CTE, MARKET_CTE, base, rounded, with_ctes

BT = base()                                    # bars by p_type
BB = base(ticker="p_brand")                    # bars by p_brand
BTM = base(market=True)                        # + market
BBM = base(ticker="p_brand", market=True)
BTG = with_ctes(BARS_CTE, MARKET_CTE, GAPPY_CTE)
BBG = with_ctes(BARS_CTE, MARKET_CTE, GAPPY_CTE, ticker="p_brand")

SECTOR_CTE = """
sbars AS (
  SELECT n.n_name AS ticker, CAST(l.l_shipdate AS DATE) AS date,
         arg_max(l.l_extendedprice / l.l_quantity, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity)) AS close,
         CAST(sum(l.l_quantity) AS DOUBLE) AS volume
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY 1, 2
)"""

LABELS_CTES = """,
fs AS (SELECT ticker, date, (lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) - close) / nullif(close, 0) AS stock_return FROM bars),
fb AS (SELECT date, (lead(close, 5) OVER (ORDER BY date) - close) / nullif(close, 0) AS benchmark_return FROM market),
lab AS (
  SELECT fs.ticker, fs.date, stock_return, benchmark_return, stock_return - benchmark_return AS excess_return,
         CAST(stock_return > benchmark_return AS INTEGER) AS outperforms
  FROM fs JOIN fb ON fs.date = fb.date
  WHERE stock_return IS NOT NULL AND benchmark_return IS NOT NULL
)"""

EQUI_GAPPY = "SELECT b.*, g.bclose, g.bvolume FROM bars b LEFT JOIN gappy g ON b.date = g.date"

O: dict[str, str] = {}

# ---- sources
O["scan_bars"] = BT + "\n" + rounded("SELECT * FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
O["scan_benchmark"] = with_ctes(MARKET_CTE) + "\n" + rounded("SELECT * FROM market", keep="date")
O["scan_universe"] = BB + "\n" + rounded("SELECT * FROM bars")
O["tz_normalize"] = """SELECT event_id,
  (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ts_local,
  CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS date_local
FROM events"""

# ---- cleansing
O["min_history"] = BB + "\n" + rounded(
    "SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 1500)")
O["missing_ratio_gate"] = BBG + f""",
j AS ({EQUI_GAPPY}),
r AS (
  SELECT ticker, (sum(CAST(open IS NULL AS INTEGER)) + sum(CAST(high IS NULL AS INTEGER)) + sum(CAST(low IS NULL AS INTEGER))
                 + sum(CAST(close IS NULL AS INTEGER)) + sum(CAST(volume IS NULL AS INTEGER)) + sum(CAST(bclose IS NULL AS INTEGER))
                 + sum(CAST(bvolume IS NULL AS INTEGER))) / (count(*) * 7) AS null_ratio
  FROM j GROUP BY ticker
)
SELECT ticker, round(null_ratio, 6) AS null_ratio, null_ratio <= 0.1 AS passed FROM r"""
O["valid_price"] = BB + "\n" + rounded("SELECT * FROM bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0")
O["min_volume"] = BB + "\n" + rounded("SELECT * FROM bars WHERE volume >= 50")
O["ffill_bars"] = BBG + f""",
j AS ({EQUI_GAPPY})
""" + rounded("""SELECT ticker, date, close,
  last_value(bclose IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bclose,
  last_value(bvolume IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bvolume
FROM j""")
O["drop_null_rows"] = BBG + f""",
j AS ({EQUI_GAPPY})
""" + rounded("SELECT * FROM j WHERE bclose IS NOT NULL AND bvolume IS NOT NULL")
O["asof_cutoff"] = BT + "\n" + rounded("SELECT * FROM bars WHERE date <= DATE '1998-06-30'")
O["recent_range"] = BTM + "\n" + rounded("SELECT * FROM bars WHERE date >= (SELECT max(date) FROM market) - 365")
O["ticker_subset"] = BB + "\n" + rounded(
    "SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM (SELECT DISTINCT ticker FROM bars) ORDER BY md5(ticker || ':42'), ticker LIMIT 8)")

# ---- labels / joins
O["forward_returns"] = BT + "\n" + rounded(
    "SELECT ticker, date, (lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) - close) / nullif(close, 0) AS fwd_return FROM bars")
O["labels"] = BTM + LABELS_CTES + "\n" + rounded("SELECT * FROM lab")
O["outperformance_summary"] = BTM + LABELS_CTES + "\n" + rounded(
    "SELECT ticker, count(*) AS n, avg(outperforms) AS outperf_rate, avg(excess_return) AS mean_excess_return FROM lab GROUP BY ticker",
    keep="ticker, n")
O["align_returns"] = BTG + "\n" + rounded("SELECT b.ticker, b.date, b.close, g.bclose, g.bvolume FROM bars b JOIN gappy g ON b.date = g.date")
O["asof_benchmark"] = BBG + "\n" + rounded(
    "SELECT b.ticker, b.date, b.close, g.bclose, g.bvolume FROM bars b ASOF LEFT JOIN gappy g ON b.date >= g.date")
O["asof_join_by_key"] = BB + """,
wk AS (SELECT ticker, date, close AS wk_close FROM bars WHERE isodow(date) <= 5)
""" + rounded("SELECT b.ticker, b.date, b.close, w.wk_close FROM bars b ASOF LEFT JOIN wk w ON b.ticker = w.ticker AND b.date >= w.date")
O["features_labels"] = BTM + LABELS_CTES + """,
f AS (SELECT ticker, date,
        CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma_20
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
""" + rounded("SELECT f.ticker, f.date, f.sma_20, b.close / nullif(f.sma_20, 0) AS close_sma_20_ratio, lab.stock_return, lab.benchmark_return, "
              "lab.excess_return, lab.outperforms FROM f JOIN bars b ON f.ticker = b.ticker AND f.date = b.date "
              "JOIN lab ON f.ticker = lab.ticker AND f.date = lab.date")
O["align_features"] = BTM + LABELS_CTES + """,
f AS (SELECT * FROM (SELECT ticker, date, close / nullif(lag(close, 20) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS momentum_20 FROM bars)
      WHERE isodow(date) <= 5)
""" + rounded("SELECT lab.*, f.momentum_20 FROM lab LEFT JOIN f ON lab.ticker = f.ticker AND lab.date = f.date")
O["wide_prices"] = BTM + "\n" + rounded("""SELECT ticker, date, close FROM bars WHERE date IN (
  SELECT date FROM bars WHERE close IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM bars))
  AND date IN (SELECT date FROM market WHERE close IS NOT NULL)""")
O["sector_lookup"] = """WITH per AS (
  SELECT n.n_name AS ticker, count(DISTINCT CAST(l.l_shipdate AS DATE)) AS n_bars
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1),
dim AS (SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'EUROPE')
SELECT per.ticker, per.n_bars, coalesce(dim.sector, 'Other') AS sector FROM per LEFT JOIN dim ON per.ticker = dim.ticker"""
O["invalid_tickers"] = """SELECT DISTINCT regexp_replace(p_brand, '#1', '#9', 'g') AS ticker FROM part
WHERE regexp_replace(p_brand, '#1', '#9', 'g') NOT IN (SELECT DISTINCT p_brand FROM part)"""
O["failed_tickers"] = BB + """
SELECT ordinal, ticker FROM (SELECT CAST(row_number() OVER (ORDER BY ticker) AS INTEGER) AS ordinal, ticker FROM (SELECT DISTINCT p_brand AS ticker FROM part))
WHERE ticker NOT IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 1500)"""
O["returns_align_dropna"] = BTG + "\n" + rounded("""SELECT s.ticker, s.date, s.s, g.bclose FROM
  (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS s FROM bars) s
  JOIN gappy g ON s.date = g.date WHERE s.s IS NOT NULL AND g.bclose IS NOT NULL""", keep="ticker, date")

# ---- split / sort / set
SPLIT_CTE = """,
pos AS (SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS row_pos, count(*) OVER () AS n_all FROM lab),
sp AS (SELECT * EXCLUDE (n_all),
         CASE WHEN row_pos < floor(floor(n_all * CAST(0.8 AS DOUBLE)) * CAST(0.8 AS DOUBLE)) THEN 'train'
              WHEN row_pos < floor(n_all * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM pos)"""
O["chrono_split"] = BTM + LABELS_CTES + SPLIT_CTE + "\n" + rounded(
    "SELECT * FROM sp", keep="ticker, date, outperforms, row_pos, split")
O["label_balance"] = BTM + LABELS_CTES + SPLIT_CTE + "\n" + rounded(
    "SELECT split, count(*) AS n, avg(outperforms) AS positive_rate, CAST(sum(outperforms) AS BIGINT) AS positives FROM sp GROUP BY split",
    keep="split, n, positives")
O["latest_row"] = BB + "\n" + rounded("SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
O["union_tickers"] = with_ctes(BARS_CTE, SECTOR_CTE) + "\n" + rounded(
    "SELECT ticker, date, close, CAST(NULL AS DOUBLE) AS volume FROM bars UNION ALL SELECT ticker, date, close, volume FROM sbars")
O["ticker_diff"] = with_ctes(BARS_CTE, SECTOR_CTE, ticker="p_brand").replace("p.p_brand AS ticker", "p.p_brand AS ticker", 1) + """,
tbars AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT DISTINCT ticker FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
b AS (SELECT DISTINCT ticker FROM bars WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31')
SELECT 'only_1996' AS kind, ticker AS value FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'only_1999', ticker FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT 'common_date', CAST(date AS VARCHAR) FROM (SELECT date FROM tbars INTERSECT SELECT date FROM sbars)"""
O["distinct_tickers"] = BB + "\nSELECT DISTINCT ticker FROM bars"
O["seeded_sample"] = BTM + LABELS_CTES + "\n" + rounded(
    "SELECT * FROM lab ORDER BY md5(concat_ws(':', ticker, CAST(date AS VARCHAR), '7')), ticker, date LIMIT 500",
    keep="ticker, date, outperforms")

ORACLE = O
