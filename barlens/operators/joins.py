"""Joins: as-of benchmark alignment, date alignment, feature/label joins, dimension lookups.

Size bounds used for broadcasting: the benchmark and any per-date table hold one row per calendar
date (<= 366 per year of history, independent of how many trades or tickers there are); the sector
and universe dimensions hold one row per ticker name.  Every other join is left to Catalyst/AQE,
which broadcasts only below the measured size threshold and otherwise sort-merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str = "date", by: list[str] | None = None,
              cols: list[str] | None = None) -> DataFrame:
    """For each left row, the right row with the greatest ``on`` <= left ``on`` (NULLs if none).

    * ``by`` given: union both sides, then carry the last right row forward inside each ``by``
      partition ordered by ``on`` (right rows sort before left rows on equal keys).  One shuffle on
      ``by``, no theta join.
    * ``by`` absent (a single reference series such as the benchmark): the carry runs over the union
      of the distinct dates of both sides -- a table bounded by the calendar -- and the filled table
      is joined back on equality of ``on``.
    """
    cols = cols or [c for c in right.columns if c != on and c not in (by or [])]
    payload = F.struct(*[F.col(c) for c in cols])
    if by:
        lt = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(payload.alias("p")).schema[0].dataType).alias("_p"))
        rt = right.select(*by, on, F.lit(0).alias("_side"), payload.alias("_p"))
        u = lt.unionByName(rt, allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        filled = u.select("*", F.last("_p", ignorenulls=True).over(w).alias("_carry"))
        out = filled.filter(F.col("_side") == 1).select(*left.columns, *[F.col("_carry")[c].alias(c) for c in cols])
        return out
    dates = left.select(on).distinct().select(on, F.lit(1).alias("_side"), F.lit(None).cast(
        right.select(payload.alias("p")).schema[0].dataType).alias("_p"))
    rdates = right.select(on, F.lit(0).alias("_side"), payload.alias("_p"))
    # calendar-sized: a single ordered window over distinct dates
    w = Window.orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = (dates.unionByName(rdates)
              .select(on, "_side", F.last("_p", ignorenulls=True).over(w).alias("_carry"))
              .filter(F.col("_side") == 1)
              .select(on, *[F.col("_carry")[c].alias(c) for c in cols]))
    return left.join(F.broadcast(filled), on, "left")


def asof_benchmark(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Attach ``bclose``/``bvolume`` of the last benchmark bar on or before each bar's date."""
    return asof_join(bars, bench.select("date", "bclose", "bvolume"), "date")


def align_returns(stock: DataFrame, bench: DataFrame, on: str = "date") -> DataFrame:
    """Inner equi-join on date (index intersection); the benchmark side is calendar-bounded."""
    return stock.join(F.broadcast(bench), on, "inner")


def features_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on (ticker, date): both sides shuffle on the same keys (sort-merge, co-partitioned)."""
    return features.join(labels, ["ticker", "date"], "inner")


def align_features(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows for every label date (left join from labels)."""
    return labels.join(features, ["ticker", "date"], "left")


def sector_lookup(df: DataFrame, sectors: DataFrame, default: str = "Other") -> DataFrame:
    return df.join(sectors, "ticker", "left").withColumn("sector", F.coalesce(F.col("sector"), F.lit(default)))


def invalid_tickers(requested: DataFrame, universe: DataFrame) -> DataFrame:
    return requested.join(universe.select("ticker"), "ticker", "left_anti")


def returns_align_dropna(a: DataFrame, b: DataFrame, on: str = "date") -> DataFrame:
    return a.join(b, on, "inner").na.drop()


def wide_prices(bars: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Long-form equivalent of outer-aligning every close by date then listwise dropna: keep only the
    dates on which every ticker (and the benchmark, if given) has a close.  No pivot, so the width
    never grows with the universe."""
    n = bars.select(F.countDistinct("ticker")).scalar()
    per_date = bars.filter(F.col("close").isNotNull()).groupBy("date").agg(F.count("*").alias("k"))
    full_dates = per_date.filter(F.col("k") == n).select("date")
    if bench is not None:
        full_dates = full_dates.join(bench.filter(F.col("bclose").isNotNull()).select("date"), "date", "left_semi")
    return bars.join(F.broadcast(full_dates), "date", "left_semi")
