"""Sharding by sampled splitters.

Records are ordered by (text hash, id hash, id), which keeps equal texts together and lets a hot group be cut
anywhere.  A size-weighted sample of keys gives quantile splitters, records are dealt to the ranges between them,
and ranges that came out overfull are subdivided by a sample of their own.  Exact prefix sums over the ranges then
place every record: shard = its place in the running total of bytes (or rows).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import staged

_LOWEST = -(1 << 63)


def _draw(rows: DataFrame, expected: float, total: float, salt: str) -> pd.DataFrame:
    """About ``expected`` rows, each drawn with a chance in proportion to its weight (certain beyond 1)."""
    chance = F.least(F.lit(1.0), F.col("weight") * F.lit(expected / max(total, 1.0)))
    u = F.pmod(F.xxhash64(F.lit(salt), "key", "tie", "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(u < chance).select("key", "tie", (F.col("weight") / chance).alias("w")).toPandas()


def _splitters(sample: pd.DataFrame, parts: int) -> list[tuple[int, int]]:
    """The keys at the sample's weighted quantiles.  A key drawn once is split before its whole group; one that
    was drawn more often is a hot group and is split at the drawn record."""
    if parts < 2 or not len(sample):
        return []
    s = sample.sort_values(["key", "tie"])
    key, tie, cum = s["key"].to_numpy(), s["tie"].to_numpy(), s["w"].cumsum().to_numpy()
    at = np.unique(np.minimum(np.searchsorted(cum, cum[-1] * np.arange(1, parts) / parts), len(s) - 1))
    hot = {k for k, n in zip(*np.unique(key, return_counts=True), strict=True) if n > 1}
    return sorted({(int(key[i]), int(tie[i]) if key[i] in hot else _LOWEST) for i in at})


def _ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with their range number; the splitters are bounded by the number of ranges."""
    keys, ties = np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(), tie.to_numpy()
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = lo.copy()
        for i in np.unique(lo[lo < hi]):  # records of a key that is itself a splitter
            m = (lo == i) & (hi > lo)
            out[m] = i + np.searchsorted(ties[i: int(hi[m][0])], t[m], "right")
        return pd.Series(out.astype(np.int32))

    return rows.withColumn("range", place("key", "tie") if splitters else F.lit(0))


def shard(docs: DataFrame, shards: int = 40, law: str = "bytes", ranges_per_shard: int = 4, sample_per_range: int = 32, rows_per_range: int = 1_000_000,
          whole_group: float = 0.02, overfull: float = 2.0, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, size, text_crc32, law, shard, slot, grown_shard``, one row per input row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16.  ``law``: ``bytes`` evens out sizes, ``rows`` counts.
    Equal texts of up to ``whole_group`` of a shard stay in one shard, larger groups are cut between records.
    ``slot`` numbers a shard's records from 0 without gaps.  Null ids sort first; an empty table has no row.
    There are ``ranges_per_shard`` ranges a shard, more if they would hold over ``rows_per_range`` rows on average;
    ``sample_per_range`` times their number bounds the sample on the driver.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"key": F.col("text_hash"), "tie": F.xxhash64(F.lit("tie"), "doc_id"),
                             "weight": (F.col("size") if law == "bytes" else F.lit(1).cast("long"))})
    rows = staged(rows, "shard-rows")
    total, n_rows = rows.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    n_ranges = max(shards * ranges_per_shard, -(-n_rows // rows_per_range))
    splitters = _splitters(_draw(rows, n_ranges * sample_per_range, total, "first"), n_ranges)
    for r in range(rounds):
        dealt = _ranges(rows, splitters)
        full = (dealt.groupBy("range").agg(F.sum("weight").alias("w"), F.max("weight").alias("most"))
                .where(F.col("w") > F.greatest(F.lit(overfull * total / n_ranges), 2 * F.col("most"))).collect())
        more = set()
        if full:
            heavy = {x["range"]: x["w"] for x in full}
            some = _draw(dealt.where(F.col("range").isin(list(heavy))), n_ranges * sample_per_range, sum(heavy.values()), f"again{r}")
            some["range"] = _ranges_of(some, splitters)
            for k, w in heavy.items():
                more |= set(_splitters(some[some["range"] == k], -(-int(w * n_ranges) // max(int(total), 1))))
        if not more - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    dealt = _ranges(rows, splitters)

    sums = dealt.groupBy("range").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.select(F.col("range").alias("r"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w_off"),
                       F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_off"))
    within = Window.partitionBy("range").orderBy("key", "tie", "doc_id", "size")
    group = Window.partitionBy("range", "key")
    placed = (dealt.withColumns({"before": F.sum("weight").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight"),
                                 "nth": F.row_number().over(within) - 1})
              .withColumns({"g_before": F.min("before").over(group), "g_weight": F.sum("weight").over(group)})
              .join(sums, F.col("range") == F.col("r")))
    ideal = F.lit(max(total, 1) / shards)
    middle = F.when(F.col("g_weight") <= F.lit(whole_group) * ideal, F.col("g_before") + F.col("g_weight") / 2).otherwise(F.col("before") + F.col("weight") / 2)
    number = F.least(F.floor((F.col("w_off") + middle) / ideal), F.lit(shards - 1)).cast("int")
    placed = placed.select("doc_id", "text_hash", "size", "text_crc32", number.alias("shard"), (F.col("n_off") + F.col("nth")).alias("row"))
    placed = staged(placed, "shard-placed")
    start = placed.groupBy("shard").agg(F.min("row").alias("start"))  # one row per shard
    return (placed.join(start, "shard")
            .select("doc_id", "text_hash", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("row") - F.col("start")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def _ranges_of(sample: pd.DataFrame, splitters: list[tuple[int, int]]) -> list[int]:
    from bisect import bisect_right

    return [bisect_right(splitters, (int(k), int(t))) for k, t in zip(sample["key"], sample["tie"], strict=True)]
