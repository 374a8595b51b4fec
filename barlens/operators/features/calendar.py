"""Calendar (seasonality) flags and pairwise feature interactions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.series import div

# Fixed: the five key features that interact, in their reference order.
KEY_FEATURES = ("rsi", "volume_ratio", "close_sma_20_ratio", "macd", "bb_position")


def seasonality(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    dow, m, q, dom = F.weekday(d), F.month(d), F.quarter(d), F.dayofmonth(d)

    def flag(c):
        return c.cast("int")

    return df.select(
        "*",
        dow.alias("day_of_week"),
        flag(dow == 0).alias("is_monday"),
        flag(dow == 4).alias("is_friday"),
        m.alias("month"),
        flag(m == 1).alias("is_january"),
        flag(m == 12).alias("is_december"),
        q.alias("quarter"),
        flag(q == 1).alias("is_q1"),
        flag(q == 4).alias("is_q4"),
        flag(dom == 1).alias("is_month_start"),
        flag(d == F.last_day(d)).alias("is_month_end"),
        dom.alias("day_of_month"),
        flag(dom <= 7).alias("is_first_week"),
        flag(dom >= 24).alias("is_last_week"),
        flag(((m == 12) & (dom >= 20)) | ((m == 1) & (dom <= 5)) | ((m == 11) & (dom >= 20))).alias("is_near_holidays"),
    )


def interactions(df: DataFrame, keys=KEY_FEATURES) -> DataFrame:
    present = [k for k in keys if k in df.columns]
    cols = []
    for a, b in combinations(present, 2):
        cols += [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}"), div(a, b).alias(f"{a}_div_{b}")]
    if "rsi" in present and "volume_ratio" in present:
        hot = F.coalesce((F.col("rsi") > 70) | (F.col("rsi") < 30), F.lit(False)).cast("int")
        cols.append((hot * F.col("volume_ratio")).alias("rsi_volume_strength"))
    return df.select("*", *cols)
