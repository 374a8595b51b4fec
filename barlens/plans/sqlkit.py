"""SQL-text fragments for the DuckDB oracle (independent of the Spark column builders).

Oracle conventions: division is ``a / nullif(b, 0)``; a trailing k-row aggregate is NULL unless all
k rows hold a value; every double output is rounded to 6 decimals.
"""

from __future__ import annotations

PART = "PARTITION BY ticker ORDER BY date"

BARS_CTE = """
bars AS (
  SELECT p.{tk} AS ticker, CAST(l.l_shipdate AS DATE) AS date,
         arg_min(l.l_extendedprice / l.l_quantity, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity)) AS open,
         max(l.l_extendedprice / l.l_quantity) AS high,
         min(l.l_extendedprice / l.l_quantity) AS low,
         arg_max(l.l_extendedprice / l.l_quantity, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity)) AS close,
         CAST(sum(l.l_quantity) AS DOUBLE) AS volume
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2
)"""

MARKET_CTE = """
market AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1
)"""

GAPPY_CTE = """
gappy AS (SELECT date, close AS bclose, volume AS bvolume FROM market WHERE isodow(date) <= 5)"""

# bars with the as-of (last on or before) weekday-only benchmark attached
RBARS_CTE = """
rbars AS (
  SELECT b.*, g.bclose, g.bvolume
  FROM bars b ASOF LEFT JOIN gappy g ON b.date >= g.date
)"""


def with_ctes(*ctes: str, ticker: str = "p_type") -> str:
    return "WITH " + ",".join(c.format(tk=ticker) for c in ctes)


def base(ticker: str = "p_type", market: bool = False, relative: bool = False) -> str:
    ctes = [BARS_CTE]
    if market or relative:
        ctes.append(MARKET_CTE)
    if relative:
        ctes += [GAPPY_CTE, RBARS_CTE]
    return with_ctes(*ctes, ticker=ticker)


def frame(k: int, part: str = PART) -> str:
    return f"({part} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def cum(part: str = PART) -> str:
    return f"({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, k: int, part: str = PART) -> str:
    f = frame(k, part)
    return f"(CASE WHEN count({x}) OVER {f} = {k} THEN {agg}({x}) OVER {f} END)"


def sma(x: str, k: int, part: str = PART) -> str:
    return roll("avg", x, k, part)


def std(x: str, k: int, part: str = PART) -> str:
    return roll("stddev_samp", x, k, part)


def lag(x: str, n: int = 1, part: str = PART) -> str:
    return f"lag({x}, {n}) OVER ({part})"


def lead(x: str, n: int = 1, part: str = PART) -> str:
    return f"lead({x}, {n}) OVER ({part})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def pct(x: str, n: int = 1, part: str = PART) -> str:
    return f"({div(x, lag(x, n, part))} - 1)"


def corr(x: str, y: str, k: int, part: str = PART) -> str:
    """covar_samp / (sd*sd) over jointly non-null pairs; NULL on zero variance or short window."""
    xj = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    yj = f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    f = frame(k, part)
    return (f"(CASE WHEN count({xj}) OVER {f} = {k} THEN covar_samp({xj}, {yj}) OVER {f} / "
            f"nullif(stddev_samp({xj}) OVER {f} * stddev_samp({yj}) OVER {f}, 0) END)")


def cov(x: str, y: str, k: int, part: str = PART) -> str:
    xj = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    yj = f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    f = frame(k, part)
    return f"(CASE WHEN count({xj}) OVER {f} = {k} THEN covar_samp({xj}, {yj}) OVER {f} END)"


def ewm(x: str, alpha: float, part: str = PART) -> str:
    """Recursive EWM folded over all earlier non-null values (NULL-initialised: the first one seeds it)."""
    a = f"CAST({float(alpha)!r} AS DOUBLE)"
    xs = f"list_filter(list({x}) OVER {cum(part)}, lambda v: v IS NOT NULL)"
    return (f"list_reduce({xs}, lambda acc, v: CASE WHEN acc IS NULL THEN v ELSE {a} * v + (1.0 - {a}) * acc END, "
            f"CAST(NULL AS DOUBLE))")


def seen(x: str, part: str = PART) -> str:
    return f"count({x}) OVER {cum(part)}"


def ema(x: str, span: int, part: str = PART) -> str:
    a = 2.0 / (span + 1.0)
    return f"(CASE WHEN {seen(x, part)} >= {span} THEN {ewm(x, a, part)} END)"


def running(op: str, x: str, part: str = PART) -> str:
    """Running sum/product as an in-order fold (matches an incremental running aggregate bit for bit)."""
    xs = f"list_filter(list({x}) OVER {cum(part)}, lambda v: v IS NOT NULL)"
    return f"list_reduce({xs}, lambda a, v: CASE WHEN a IS NULL THEN v ELSE a {op} v END, CAST(NULL AS DOUBLE))"


def rounded(inner: str, keep: str = "ticker, date", digits: int = 6) -> str:
    """Round every non-key column (all must be numeric)."""
    return f"SELECT {keep}, round(COLUMNS(* EXCLUDE ({keep})), {digits}) FROM ({inner})"
