"""Classification / ranking metrics and drift statistics as distributed aggregations.

Global orderings (rank-sum AUC, PR curve, KS) never use an un-partitioned window over the data:
rows are first collapsed to distinct values (a hot value becomes one row), distinct values are
range-sorted, partition totals get a prefix sum, and each row adds its running sum within the
partition to the partition's offset.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, order: str, cols: list[str], keys: list[str] | None = None,
                buckets: int | None = None, inclusive: bool = True) -> DataFrame:
    """Running sums of ``cols`` in ``order`` (unique within ``keys``); adds ``cum_<c>`` for each c.

    A range sort on (keys, order) cuts every key into as many slices as its rows need (``buckets``: number
    of range partitions, by default sized by the session); slice totals (a row per key and partition) give
    the offsets.  The sorted table is checkpointed in the shared folder, which fixes the partition numbers
    that the totals and the rows both refer to.
    """
    from barlens.session import checkpoint_dir

    keys = keys or []
    checkpoint_dir(df.sparkSession)
    by = [F.col(c) for c in (*keys, order)]
    t = df.repartitionByRange(buckets, *by) if buckets else df.repartitionByRange(*by)
    t = t.withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    tot = t.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in cols])
    hi = 0 if inclusive else -1
    w = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, hi)
    j = t.join(off, [*keys, "_part"])
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"cum_{c}") for c in cols])


def score_counts(scored: DataFrame, score: str = "score", label: str = "label", keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label", keys: list[str] | None = None,
            buckets: int | None = None) -> DataFrame:
    """Rank-sum AUC with average ranks for ties: for every positive, negatives scored lower count 1
    and tied negatives count 1/2."""
    keys = keys or []
    sc = score_counts(scored, score, label, keys)
    c = prefix_sums(sc, score, ["neg"], keys, buckets, inclusive=False)
    part = F.col("pos").cast("double") * (F.col("cum_neg").cast("double") + F.col("neg").cast("double") / 2.0)
    agg = c.groupBy(*keys).agg(F.sum(part).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(*keys, F.try_divide(F.col("_u"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double")).alias("auc"),
                      "n_pos", "n_neg")


def class_metrics(scored: DataFrame, pred: str = "pred", label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """accuracy, precision / recall / F1 of class 1 (0 where undefined, as scikit-learn reports)."""
    keys = keys or []
    p, y = F.col(pred).cast("int"), F.col(label).cast("int")
    a = scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum((p == y).cast("long")).alias("correct"),
        F.sum(((p == 1) & (y == 1)).cast("long")).alias("tp"),
        F.sum(((p == 1) & (y == 0)).cast("long")).alias("fp"),
        F.sum(((p == 0) & (y == 1)).cast("long")).alias("fn"),
    )
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    a = a.select("*", (F.col("correct") / F.col("n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return a.select("*", f1.alias("f1_score"))


def pr_curve(scored: DataFrame, score: str = "score", label: str = "label", buckets: int | None = None) -> DataFrame:
    """Precision/recall at every distinct score threshold t (predicted positive = score >= t)."""
    sc = score_counts(scored, score, label)
    c = prefix_sums(sc, score, ["pos", "neg"], None, buckets, inclusive=False)
    P = sc.select(F.sum("pos")).scalar()
    N = sc.select(F.sum("neg")).scalar()
    tp = P - F.col("cum_pos")
    fp = N - F.col("cum_neg")
    return c.select(F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0)).alias("precision"),
                    F.try_divide(tp.cast("double"), P.cast("double")).alias("recall"))


def avg_precision(curve: DataFrame) -> DataFrame:
    """The reference's 'avg_precision': plain mean of the precision array including the final 1.0."""
    return curve.agg(((F.sum("precision") + 1.0) / (F.count("*") + 1)).alias("avg_precision"))


def calibration(scored: DataFrame, prob: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """confidence = |p - .5| * 2 in half-open bins [i/10, (i+1)/10); confidence 1.0 falls outside.
    Per bin: count, mean confidence, accuracy of (p > .5) against the label."""
    conf = F.abs(F.col(prob) - 0.5) * 2.0
    t = scored.select(conf.alias("confidence"), ((F.col(prob) > 0.5).cast("int") == F.col(label)).cast("double").alias("hit"))
    # bin i holds i/bins <= confidence < (i+1)/bins, tested against the same boundary doubles
    bounds = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.size(F.filter(bounds, lambda x: F.col("confidence") >= x))
    t = t.filter(F.col("confidence") < 1.0).select("*", b.cast("int").alias("bin"))
    return t.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("accuracy"))


def perf_gate(metrics: DataFrame, min_accuracy: float = 0.55, min_auc: float = 0.60, min_precision: float = 0.55) -> DataFrame:
    """Plan rule: retrain when accuracy, AUC or precision falls under its floor."""
    return metrics.select("*", ((F.col("accuracy") < min_accuracy) | (F.col("auc") < min_auc)
                                | (F.col("precision") < min_precision)).alias("needs_retrain"))


def ks_drift(long: DataFrame, key: str = "feature", value: str = "value", sample: str = "sample",
             alpha: float = 0.05, buckets: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per ``key``: ``sample`` is 0 (reference) or 1 (current).
    D = max |F0 - F1| over distinct values; asymptotic p-value; drift when p < alpha."""
    c = long.filter(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.sum((F.col(sample) == 0).cast("long")).alias("c0"), F.sum((F.col(sample) == 1).cast("long")).alias("c1"))
    p = prefix_sums(c, value, ["c0", "c1"], [key], buckets, inclusive=True)
    n = c.groupBy(key).agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    d = p.join(n, key).select(key, "n0", "n1", F.abs(F.try_divide("cum_c0", "n0") - F.try_divide("cum_c1", "n1")).alias("gap"))
    s = d.groupBy(key, "n0", "n1").agg(F.max("gap").alias("ks_stat"))
    ne = F.try_divide((F.col("n0") * F.col("n1")).cast("double"), (F.col("n0") + F.col("n1")).cast("double"))
    # a feature with rows in one sample only has no statistic: ks_stat and p_value are null
    lam = (F.sqrt(ne) + 0.12 + F.try_divide(F.lit(0.11), F.sqrt(ne))) * F.col("ks_stat")
    # Kolmogorov survival function Q(lam): the alternating series converges fast for lam >= 1.18;
    # below that use the equivalent theta-function form 1 - sqrt(2 pi)/lam * sum exp(-(2k-1)^2 pi^2 / (8 lam^2)).
    ks = F.sequence(F.lit(1), F.lit(100))
    big = 2.0 * F.aggregate(F.transform(ks, lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam)),
                            F.lit(0.0), lambda a, v: a + v)
    small = 1.0 - F.try_divide(F.lit(math.sqrt(2.0 * math.pi)), lam) * F.aggregate(
        F.transform(ks, lambda k: F.exp(F.try_divide(-((2 * k - 1) * (2 * k - 1)) * (math.pi * math.pi), 8.0 * lam * lam))),
        F.lit(0.0), lambda a, v: a + v)
    q = F.when(lam.isNull(), F.lit(None).cast("double")).when(lam <= 0, F.lit(1.0)).when(lam < 1.18, small).otherwise(big)
    pval = F.when(q.isNotNull(), F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))
    return s.select("*", pval.alias("p_value")).select("*", (F.col("p_value") < alpha).alias("drift"))
