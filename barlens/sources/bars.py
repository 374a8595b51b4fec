"""Bar views derived from the provided tables.

``bars``: one OHLCV row per (ticker, date).  A ticker is a part attribute (``p_type`` gives 6 series,
``p_brand`` 25), a trade is a lineitem: price = extendedprice / quantity, size = quantity.  Open and
close are the first and last trade of the day in the order of the six-column line key (the first
two columns alone are not unique; price is a function of the last two, so full ties are harmless).

The bar build is a single ``groupBy(ticker, date)``: partial aggregation runs map-side, so a hot
ticker or date is pre-aggregated to one row per task before the shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.session import checkpoint_dir
from barlens.sources.tables import read

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
BAR_COLS = ["ticker", "date", "open", "high", "low", "close", "volume"]


def _trades(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", LINE_KEY + ["l_shipdate"])
    # typed TIMESTAMP_NTZ literals: independent of the driver's time zone, and the comparison stays on
    # the raw column so the predicate reaches the parquet scan
    if start is not None:
        li = li.filter(F.col("l_shipdate") >= F.expr(f"TIMESTAMP_NTZ '{_as_date(start).isoformat()} 00:00:00'"))
    if end is not None:  # inclusive end date
        nxt = _as_date(end) + _dt.timedelta(days=1)
        li = li.filter(F.col("l_shipdate") < F.expr(f"TIMESTAMP_NTZ '{nxt.isoformat()} 00:00:00'"))
    return li.select(
        *LINE_KEY,
        F.to_date("l_shipdate").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
    )


def _as_date(d):
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d))


def ohlcv(trades: DataFrame, keys: list[str], order: list[str], price: str = "price", size: str = "l_quantity") -> DataFrame:
    """Aggregate trades to OHLCV per ``keys``; first/last by the ``order`` struct."""
    o = F.struct(*[F.col(c) for c in order])
    return trades.groupBy(*keys).agg(
        F.min_by(F.col(price), o).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(F.col(price), o).alias("close"),
        F.sum(size).cast("double").alias("volume"),
    )


def series_partitioned(df: DataFrame, key: str = "ticker", n: int | None = None) -> DataFrame:
    """Range-partition a bars-sized table by series with an explicit partition count.

    Every per-series window then finds its clustering already in place (no further exchange), the
    sampled range bounds give each series -- and a hot one -- its own task, and AQE does not coalesce
    an explicitly numbered repartition (it would otherwise merge a small bars shuffle into one task
    and run every series' windows on one core).
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, key)


def bars(spark: SparkSession, sf_dir: str, ticker: str = "p_type", start=None, end=None) -> DataFrame:
    """``scan_bars``: lineitem joined to part, aggregated to daily bars per ticker.

    The part side is only ``(p_partkey, ticker)``; Spark broadcasts it when its measured size is under
    the broadcast threshold and falls back to a sort-merge join otherwise.  The result is
    range-partitioned by ticker (``series_partitioned``).
    """
    part = read(spark, sf_dir, "part", ["p_partkey", ticker]).withColumnRenamed(ticker, "ticker")
    t = _trades(spark, sf_dir, start, end).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return series_partitioned(ohlcv(t, ["ticker", "date"], LINE_KEY).select(*BAR_COLS))


def market_bars(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """``scan_benchmark``: the same bars over every trade of a date (the market series)."""
    return ohlcv(_trades(spark, sf_dir, start, end), ["date"], LINE_KEY).select(*BAR_COLS[1:])


def bars_and_market(spark: SparkSession, sf_dir: str, ticker: str = "p_type", start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """``bars`` and ``market_bars``, each checkpointed: plans that read the bars many times (features, labels, split) scan
    and sort the trades behind them once for each."""
    checkpoint_dir(spark)
    b = bars(spark, sf_dir, ticker, start, end).checkpoint(eager=True)
    return series_partitioned(b), market_bars(spark, sf_dir, start, end).checkpoint(eager=True)


def market_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark restricted to weekdays: holes against the series exercise the as-of fill."""
    m = market_bars(spark, sf_dir)
    return m.filter(F.weekday("date") < 5)


def as_benchmark(market: DataFrame) -> DataFrame:
    return market.select("date", F.col("close").alias("bclose"), F.col("volume").alias("bvolume"))


def sector_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker = supplier nation, sector = its region (25 x 5 rows)."""
    n = read(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")
    )


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per supplier nation."""
    s = read(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    n = read(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    sup = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("ticker")
    )
    t = _trades(spark, sf_dir).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return series_partitioned(ohlcv(t, ["ticker", "date"], LINE_KEY).select(*BAR_COLS))


def universe(spark: SparkSession, sf_dir: str, ticker: str = "p_type") -> DataFrame:
    """Universe dimension ``(ordinal, ticker)``: distinct ticker names in name order.

    The dimension is one row per distinct attribute value (bounded by the catalogue, not the trade
    volume), so the global ordinal window runs over a small table.
    """
    from pyspark.sql import Window

    d = read(spark, sf_dir, "part", [ticker]).select(F.col(ticker).alias("ticker")).distinct()
    return d.select(F.row_number().over(Window.orderBy("ticker")).cast("int").alias("ordinal"), "ticker")


def event_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Hourly bars of ``events.value`` per ``event_type``; volume = number of events."""
    ev = read(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    w = F.window("ts", width)
    g = ev.groupBy(F.col("event_type").alias("ticker"), w.alias("w")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return g.select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")
