"""DuckDB oracle SQL for the pipeline queries that have one (batch resampling of events to bars)."""

from __future__ import annotations

from barlens.plans.analytics_oracle import FEATURES, FRAME, SIGNALS_SQL
from barlens.plans.core_oracle import BB
from barlens.plans.sqlkit import rounded

O: dict[str, str] = {}
O["resample_bars"] = rounded("""SELECT event_type AS ticker, date_trunc('hour', ts) AS bar_start,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2""", keep="ticker, bar_start")

# the stream has seen all events, so its bars are the batch bars
O["stream_bars"] = O["resample_bars"]

# two fetches of the same events land once
O["stream_dedup"] = "SELECT DISTINCT event_id, ts, event_type, value FROM events"

# persistence round trips: what is read back equals what was written
O["write_bars"] = BB + "\n" + rounded("SELECT * FROM bars")
_F = ", ".join(FEATURES)
O["write_processed"] = FRAME + "\n" + rounded(f"SELECT ticker, date, {_F} FROM frame")
O["read_processed"] = FRAME + "\n" + rounded(f"SELECT ticker, date, {_F}, outperforms FROM frame", keep="ticker, date, outperforms")

# a set per year of trades; the last year has no labels, so it is not listed
O["latest_version"] = """WITH y AS (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT 'training' AS prefix, CAST(y AS VARCHAR) || '1231_000000' AS version FROM y WHERE y < (SELECT max(y) FROM y)"""
# all files of a table written at once are fresh
O["fresh_scan"] = "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem"
# the newest bar of every series with at least 50 bars, whether or not its label is known yet
O["score_rows"] = rounded(SIGNALS_SQL + """
SELECT ticker, date AS prediction_date, close AS last_price, n_rows, """ + _F + """
FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_rows, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM sig1)
WHERE rn = 1 AND n_rows >= 50""", keep="ticker, prediction_date, n_rows")

ORACLE = O
