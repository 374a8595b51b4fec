"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums
of token counts, and a cut at each source's budget, over as many epochs as the budget needs.

Only (id, text hash, source, size) rows are sorted; a range partition holds a slice of one or more sources, so a
hot source spreads over many.  Partition totals, one row per partition and source, give the prefix sums their
offsets; targets are one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import WORD, staged


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and divide ``share`` of all sizes by weight;
    none gets more than ``most`` times its size, what it would get beyond is shared out again by weight.  In the
    order of cap / weight the capped sources come first, so one running sum settles them all.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    src = sources.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumns({"total": F.sum("source_size").over(whole) * F.lit(float(share)),
                           "gone": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("w").over(onward)})
    src = src.withColumn("capped", F.col("cap") * F.col("left") <= F.col("w") * (F.col("total") - F.col("gone")))
    free = F.when(~F.col("capped"), F.struct("gone", "left"))
    level = F.min(free).over(whole)
    level = F.when(level.isNotNull(), (F.col("total") - level["gone"]) / level["left"])
    src = src.withColumn("level", level)
    return src.select("source", "source_size", F.when(F.col("capped") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, copies, taken``, one row per input row.

    ``size`` counts the words of the whole text (null: 0).  Every document is taken ``copies`` times: the whole
    epochs that fit the target, and once more when it lies before the cut in the source's random order (a
    document across the cut goes to the nearer side).  Random keys are md5 hashes of ``seed`` and the id, ties
    go by id and text hash, so reruns agree.  Null sources are a source of their own; null ids are carried.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
                       F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")))
    order = ["key", "doc_id", "text_hash"]
    rows = rows.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id())
    rows = staged(rows, "mix-sorted")  # the partition numbers are now fixed

    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("offset", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))), "mix-parts")
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    goal = (parts.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .select(F.col("source").alias("s"), F.col("part").alias("p"), "offset", "source_size", "target"))

    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(goal, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    within = 2.0 * (F.col("offset") + F.col("before")) + F.col("size") <= 2.0 * rest
    copies = epochs + F.when(within & (F.col("size") > 0), 1).otherwise(0)
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))
