"""Chronological train/validation/test split without a global single-task window.

The reference sorts all rows by date and cuts by row position: test_start = int(n * (1 - test)),
val_start = int(test_start * (1 - val)).  Here rows are numbered as (rows on earlier dates) + (rank
within the date by ticker): the per-date count table is bounded by the calendar, so its prefix sum
is cheap, and the within-date rank is a window partitioned by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.session import checkpoint_dir


def row_positions(df: DataFrame, order: str = "date", tiebreak: str = "ticker") -> DataFrame:
    """Adds ``row_pos`` (0-based position in (order, tiebreak) order) and ``n_rows`` (table size).

    Both come from the per-date count table (calendar-sized): its running sum gives the rows before
    each date and its total gives the table size.  The counts and the rows read the same checkpoint, so the input
    plan is evaluated once."""
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    per = df.groupBy(order).agg(F.count("*").alias("_nd"))
    before = F.coalesce(F.sum("_nd").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(order, before.alias("_before"), F.sum("_nd").over(Window.partitionBy()).alias("n_rows"))
    within = F.row_number().over(Window.partitionBy(order).orderBy(tiebreak)) - 1
    return df.join(F.broadcast(per), order).select("*", (F.col("_before") + within).alias("row_pos")).drop("_before")


def chrono_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.2) -> DataFrame:
    p = row_positions(df)
    test_start = F.floor(F.col("n_rows") * F.lit(1.0 - test_size))
    val_start = F.floor(test_start * F.lit(1.0 - val_size))
    split = F.when(F.col("row_pos") < val_start, "train").when(F.col("row_pos") < test_start, "val").otherwise("test")
    return p.select("*", split.alias("split")).drop("n_rows")


def label_balance(df: DataFrame, label: str = "outperforms") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.avg(label).alias("positive_rate"),
                                   F.sum(label).cast("bigint").alias("positives"))
