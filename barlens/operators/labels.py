"""Forward returns and out-performance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.series import div

HORIZON = 5


def forward_returns(df: DataFrame, horizon: int = HORIZON, key: str | None = "ticker",
                    price: str = "close", name: str = "fwd_return") -> DataFrame:
    """(C[t+h] - C[t]) / C[t] on each series' own rows.

    ``key=None`` is for a single series (the benchmark): the window then spans the per-date table,
    which is bounded by the calendar.
    """
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("date")
    fut = F.lead(F.col(price), horizon).over(w)
    return df.select("*", div(fut - F.col(price), F.col(price)).alias(name))


def labels(bars: DataFrame, bench: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Inner-join stock and benchmark forward returns on date, label out-performance, drop the tail.

    Output: ticker, date, stock_return, benchmark_return, excess_return, outperforms (int).
    """
    s = forward_returns(bars.select("ticker", "date", "close"), horizon).select(
        "ticker", "date", F.col("fwd_return").alias("stock_return"))
    b = forward_returns(bench.select("date", "close"), horizon, key=None).select(
        "date", F.col("fwd_return").alias("benchmark_return"))
    j = s.join(F.broadcast(b), "date", "inner")
    out = j.select(
        "ticker", "date", "stock_return", "benchmark_return",
        (F.col("stock_return") - F.col("benchmark_return")).alias("excess_return"),
        (F.col("stock_return") > F.col("benchmark_return")).cast("int").alias("outperforms"),
    )
    return out.na.drop()


def cum_excess(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Per-ticker running sum of the trailing ``horizon``-bar excess return (stock vs aligned benchmark)."""
    from barlens.functions.series import CUM, pct

    ex = pct("close", horizon) - pct("bclose", horizon)
    t = df.select("*", ex.alias("trailing_excess"))
    return t.select("*", F.sum("trailing_excess").over(CUM()).alias("cum_excess"))
