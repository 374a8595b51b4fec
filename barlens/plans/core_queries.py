"""Registered queries: sources, cleansing, labels, joins, splits, sort/top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.functions.series import rnd
from barlens.operators import clean as CL
from barlens.operators import joins as J
from barlens.operators import labels as L
from barlens.operators import split as S
from barlens.sources import bars as SB
from barlens.sources.store import fresh_files
from barlens.sources.tables import read


def _bars(spark, sf, ticker="p_type"):
    return SB.bars(spark, sf, ticker)


def _market(spark, sf):
    return SB.market_bars(spark, sf)


def _gappy_equi(spark, sf, ticker="p_brand"):
    """Bars left-joined on equal date to the weekday-only benchmark: weekend rows carry NULLs."""
    g = SB.as_benchmark(SB.market_gappy(spark, sf))
    return _bars(spark, sf, ticker).join(F.broadcast(g), "date", "left")


def _labels(spark, sf, ticker="p_type"):
    return L.labels(_bars(spark, sf, ticker), _market(spark, sf))


# ---- sources ---------------------------------------------------------------------------------------

def scan_bars(spark, sf):
    return rnd(SB.bars(spark, sf, "p_type", start="1996-01-01", end="1999-12-31"))


def scan_benchmark(spark, sf):
    return rnd(_market(spark, sf), keep=("date",))


def scan_universe(spark, sf, n=None):
    """Bars of the whole universe, or of its first ``n`` tickers."""
    u = SB.universe(spark, sf, "p_brand")
    u = (u if n is None else u.filter(F.col("ordinal") <= n)).select("ticker")
    return rnd(_bars(spark, sf, "p_brand").join(u, "ticker", "left_semi"))


def tz_normalize(spark, sf):
    """Naive event timestamps read as UTC instants and converted to US/Eastern wall time and date."""
    ev = read(spark, sf, "events", ["event_id", "ts"])
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return ev.select("event_id", local.alias("ts_local"), F.to_date(local).alias("date_local"))


def fresh_scan(spark, sf, ttl_days=1, now=None):
    """Rows of files modified within ``ttl_days`` before ``now`` (default: the newest file's time)."""
    li = fresh_files(spark, f"{sf.rstrip('/')}/lineitem.parquet", ttl_days, now)
    return li.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("l_shipdate"))


# ---- cleansing ----------------------------------------------------------------------------------------

def min_history(spark, sf, min_rows=1500):
    return rnd(CL.min_history(_bars(spark, sf, "p_brand"), min_rows))


def missing_ratio_gate(spark, sf, max_ratio=0.1):
    cols = CL.OHLCV + ["bclose", "bvolume"]
    r = CL.missing_ratio(_gappy_equi(spark, sf), cols)
    return rnd(r.select("ticker", "null_ratio", (F.col("null_ratio") <= max_ratio).alias("passed")))


def valid_price(spark, sf):
    return rnd(CL.valid_price(_bars(spark, sf, "p_brand")))


def min_volume(spark, sf, threshold=50):
    return rnd(CL.min_volume(_bars(spark, sf, "p_brand"), threshold))


def ffill_bars(spark, sf):
    return rnd(CL.ffill_bars(_gappy_equi(spark, sf), ["bclose", "bvolume"]).select("ticker", "date", "close", "bclose", "bvolume"))


def drop_null_rows(spark, sf):
    return rnd(CL.drop_null_rows(_gappy_equi(spark, sf)))


def asof_cutoff(spark, sf, as_of="1998-06-30"):
    return rnd(CL.asof_cutoff(_bars(spark, sf), as_of))


def recent_range(spark, sf, days=365):
    """Bars of the last ``days`` days of the market; the bound is a literal that reaches the trade scan."""
    start = CL.recent_start(read(spark, sf, "lineitem", ["l_shipdate"]), days, "l_shipdate")
    return rnd(SB.bars(spark, sf, "p_type", start=start))


def ticker_subset(spark, sf, n=8, seed=42):
    return rnd(CL.ticker_subset(_bars(spark, sf, "p_brand"), n, seed))


# ---- labels / joins ---------------------------------------------------------------------------------

def forward_returns(spark, sf):
    return rnd(L.forward_returns(_bars(spark, sf).select("ticker", "date", "close"), 5).select("ticker", "date", "fwd_return"))


def labels(spark, sf):
    return rnd(_labels(spark, sf))


def outperformance_summary(spark, sf):
    """Flagship: per series, how often it beat the market over the next 5 bars and by how much."""
    lab = _labels(spark, sf)
    return rnd(lab.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("outperforms").alias("outperf_rate"),
                                         F.avg("excess_return").alias("mean_excess_return")))


def align_returns(spark, sf):
    s = _bars(spark, sf).select("ticker", "date", F.col("close"))
    b = SB.as_benchmark(SB.market_gappy(spark, sf))
    return rnd(J.align_returns(s, b))


def asof_benchmark(spark, sf):
    b = SB.as_benchmark(SB.market_gappy(spark, sf))
    return rnd(J.asof_benchmark(_bars(spark, sf, "p_brand").select("ticker", "date", "close"), b))


def asof_join_by_key(spark, sf):
    """As-of join with a partition key: each p_brand bar gets the close of the latest weekday bar of the
    same ticker on or before its date."""
    left = _bars(spark, sf, "p_brand").select("ticker", "date", "close")
    right = _bars(spark, sf, "p_brand").filter(F.weekday("date") < 5).select("ticker", "date", F.col("close").alias("wk_close"))
    return rnd(J.asof_join(left, right, "date", by=["ticker"], cols=["wk_close"]))


def features_labels(spark, sf):
    from barlens.operators.features.technical import sma_features
    f = sma_features(_bars(spark, sf)).select("ticker", "date", "sma_20", "close_sma_20_ratio")
    return rnd(J.features_labels(f, _labels(spark, sf)))


def align_features(spark, sf):
    from barlens.operators.features.momentum import momentum
    f = momentum(_bars(spark, sf)).select("ticker", "date", "momentum_20").filter(F.weekday("date") < 5)
    return rnd(J.align_features(_labels(spark, sf), f))


def wide_prices(spark, sf):
    b = SB.as_benchmark(_market(spark, sf))
    return rnd(J.wide_prices(_bars(spark, sf).select("ticker", "date", "close"), b))


def sector_lookup(spark, sf):
    perf = SB.sector_bars(spark, sf).groupBy("ticker").agg(F.count("*").alias("n_bars"))
    # a dimension that leaves some tickers unmapped: only regions whose name sorts before 'EUROPE'
    dim = SB.sector_dim(spark, sf).filter(F.col("sector") < "EUROPE")
    return J.sector_lookup(perf, dim)


def invalid_tickers(spark, sf):
    req = SB.universe(spark, sf, "p_brand").select(F.regexp_replace("ticker", "#1", "#9").alias("ticker")).distinct()
    return J.invalid_tickers(req, SB.universe(spark, sf, "p_brand"))


def failed_tickers(spark, sf, min_rows=1500):
    """Universe tickers that produced no result (here: no bars after the min-history gate)."""
    done = CL.min_history(_bars(spark, sf, "p_brand"), min_rows).select("ticker").distinct()
    return SB.universe(spark, sf, "p_brand").join(done, "ticker", "left_anti")


def returns_align_dropna(spark, sf):
    s = _bars(spark, sf).select("ticker", "date", F.col("close").alias("s_close"))
    b = SB.as_benchmark(SB.market_gappy(spark, sf)).select("date", "bclose")
    s = s.select("ticker", "date", (F.try_divide(F.col("s_close"), F.lag("s_close").over(Window.partitionBy("ticker").orderBy("date"))) - 1).alias("s"))
    return rnd(J.returns_align_dropna(s, b))


# ---- split / sort / set ---------------------------------------------------------------------------

def chrono_split(spark, sf):
    return rnd(S.chrono_split(_labels(spark, sf)))


def label_balance(spark, sf):
    return rnd(S.label_balance(S.chrono_split(_labels(spark, sf))), keep=("split",))


def latest_row(spark, sf):
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    b = _bars(spark, sf, "p_brand")
    return rnd(b.select("*", F.row_number().over(w).alias("_rn")).filter("_rn = 1").drop("_rn"))


def union_tickers(spark, sf):
    a = _bars(spark, sf, "p_type").select("ticker", "date", "close")
    b = SB.sector_bars(spark, sf).select("ticker", "date", "close", "volume")
    return rnd(a.unionByName(b, allowMissingColumns=True))


def ticker_diff(spark, sf):
    """Tickers only in the 1996 bars, only in the 1999 bars, and dates common to both universes."""
    a = SB.bars(spark, sf, "p_brand", start="1996-01-01", end="1996-12-31").select("ticker").distinct()
    b = SB.bars(spark, sf, "p_brand", start="1999-01-01", end="1999-12-31").select("ticker").distinct()
    only_a = a.subtract(b).select(F.lit("only_1996").alias("kind"), F.col("ticker").alias("value"))
    only_b = b.subtract(a).select(F.lit("only_1999").alias("kind"), F.col("ticker").alias("value"))
    da = _bars(spark, sf, "p_type").select("date")
    db = SB.sector_bars(spark, sf).select("date")
    common = da.intersect(db).select(F.lit("common_date").alias("kind"), F.col("date").cast("string").alias("value"))
    return only_a.unionByName(only_b).unionByName(common)


def distinct_tickers(spark, sf):
    return _bars(spark, sf, "p_brand").select("ticker").distinct()


def seeded_sample(spark, sf, n=500, seed=7):
    """Exactly n rows without replacement: the n smallest md5(key || seed) hashes."""
    lab = _labels(spark, sf)
    h = F.md5(F.concat_ws(":", F.col("ticker"), F.col("date").cast("string"), F.lit(str(seed))))
    return rnd(lab.orderBy(h, "ticker", "date").limit(n))


QUERIES = {
    "scan_bars": scan_bars, "scan_benchmark": scan_benchmark, "scan_universe": scan_universe,
    "tz_normalize": tz_normalize, "fresh_scan": fresh_scan,
    "min_history": min_history, "missing_ratio_gate": missing_ratio_gate, "valid_price": valid_price,
    "min_volume": min_volume, "ffill_bars": ffill_bars, "drop_null_rows": drop_null_rows,
    "asof_cutoff": asof_cutoff, "recent_range": recent_range, "ticker_subset": ticker_subset,
    "forward_returns": forward_returns, "labels": labels, "outperformance_summary": outperformance_summary,
    "align_returns": align_returns, "asof_benchmark": asof_benchmark, "asof_join_by_key": asof_join_by_key,
    "features_labels": features_labels, "align_features": align_features, "wide_prices": wide_prices,
    "sector_lookup": sector_lookup, "invalid_tickers": invalid_tickers, "failed_tickers": failed_tickers,
    "returns_align_dropna": returns_align_dropna,
    "chrono_split": chrono_split, "label_balance": label_balance, "latest_row": latest_row,
    "union_tickers": union_tickers, "ticker_diff": ticker_diff, "distinct_tickers": distinct_tickers,
    "seeded_sample": seeded_sample,
}
