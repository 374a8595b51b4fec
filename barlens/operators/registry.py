"""Scored-signal registry and leaderboards.

A registry row describes one scorer evaluated on one universe size: name, universe size, metrics on
the test split, training-sample count, a file name ``<name>_<n>stocks_v1`` and a timestamp.  Rows
come either from saved MLlib models (``models.save_model``) or from deterministic signals scored
against the out-performance label, which lets every leaderboard query run on the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.operators.metrics import class_metrics, roc_auc

METRICS = ["auc", "accuracy", "precision", "recall", "f1_score"]


def squash(x) -> "F.Column":
    """A probability in (0, 1) from a signal: 0.5 + 0.5 * z / (1 + |z|), z = 10x (pure arithmetic)."""
    z = F.col(x) * 10.0 if isinstance(x, str) else x * 10.0
    return F.lit(0.5) + F.lit(0.5) * z / (F.lit(1.0) + F.abs(z))


def signal_long(frame: DataFrame, signals: list[str], sizes: list[int], universe: DataFrame) -> DataFrame:
    """(model_name, stocks_count, ticker, date, split, score, label, pred, prob) -- every row is
    replicated once per universe size that contains its ticker (explode over the size list, no join
    against the size table)."""
    f = frame.join(universe, "ticker")
    long = f.select("ticker", "date", "split", "ordinal", F.col("outperforms").alias("label"),
                    F.explode(F.array(*[F.struct(F.lit(s).alias("model_name"), F.col(s).cast("double").alias("score"))
                                        for s in signals])).alias("sg"))
    long = long.select("*", F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n >= F.col("ordinal"))).alias("stocks_count"))
    long = long.select(F.col("sg.model_name").alias("model_name"), "stocks_count", "ticker", "date", "split",
                       F.col("sg.score").alias("score"), "label")
    long = long.filter(F.col("score").isNotNull())
    return long.select("*", (F.col("score") > 0).cast("int").alias("pred"), squash("score").alias("prob"))


def registry(long: DataFrame) -> DataFrame:
    keys = ["model_name", "stocks_count"]
    test = long.filter(F.col("split") == "test")
    auc = roc_auc(test, "score", "label", keys).select(*keys, "auc")
    cm = class_metrics(test, "pred", "label", keys).select(*keys, "accuracy", "precision", "recall", "f1_score")
    train_n = long.filter(F.col("split") == "train").groupBy(*keys).agg(F.count("*").alias("training_samples"))
    r = auc.join(cm, keys, "full").join(train_n, keys, "left")
    fname = F.concat(F.col("model_name"), F.lit("_"), F.col("stocks_count").cast("string"), F.lit("stocks_v1.model"))
    ts = F.format_string("2024-01-%02d %02d:00:00", F.col("stocks_count"), F.length("model_name"))
    return r.select(fname.alias("file_name"), "model_name", "stocks_count", ts.alias("timestamp"),
                    F.lit(1).alias("feature_count"), *METRICS, "training_samples")


def registry_scan(reg: DataFrame) -> DataFrame:
    """Parse model name and universe size back from the file name; missing metrics default to 0.0;
    best AUC first."""
    name = F.regexp_extract("file_name", r"(.+)_(\d+)stocks_", 1)
    n = F.regexp_extract("file_name", r"(.+)_(\d+)stocks_", 2).cast("int")
    out = reg.select("file_name", name.alias("parsed_model"), n.alias("parsed_stocks"),
                     *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in METRICS], "training_samples")
    return out.orderBy(F.col("auc").desc(), "file_name")


def leaderboard_by_type(reg: DataFrame) -> DataFrame:
    return reg.groupBy("model_name").agg(F.count("*").alias("runs"), *[F.avg(m).alias(f"mean_{m}") for m in METRICS[:4]])


def best_per_group(reg: DataFrame, group: str = "stocks_count", metric: str = "auc") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(metric).desc(), "model_name")
    return reg.select("*", F.row_number().over(w).alias("_rn")).filter("_rn = 1").drop("_rn")


def best_model_counts(reg: DataFrame) -> DataFrame:
    return best_per_group(reg).groupBy("model_name").agg(F.count("*").alias("wins"))


def scaling_report(reg: DataFrame) -> DataFrame:
    best = best_per_group(reg).select("stocks_count", F.col("model_name").alias("best_model"), F.col("auc").alias("best_auc"))
    agg = reg.groupBy("stocks_count").agg(F.avg("auc").alias("mean_auc"), F.avg("accuracy").alias("mean_accuracy"),
                                          F.max("training_samples").alias("training_samples"))
    return agg.join(best, "stocks_count")


def best_per_metric(reg: DataFrame) -> DataFrame:
    """Best model for every metric with a positive score (argmax with a name tie-break)."""
    long = reg.select("model_name", "stocks_count", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])).alias("m"))
    long = long.select("model_name", "stocks_count", "m.metric", "m.score").filter(F.col("score") > 0)
    w = Window.partitionBy("metric").orderBy(F.col("score").desc(), "model_name", "stocks_count")
    return long.select("*", F.row_number().over(w).alias("_rn")).filter("_rn = 1").drop("_rn")


def latest_models(reg: DataFrame, k: int = 3) -> DataFrame:
    """The k newest registry rows (timestamp, then file name as tie-break)."""
    return reg.orderBy(F.col("timestamp").desc(), F.col("file_name")).limit(k)


def best_model(reg: DataFrame, metric: str = "auc", newest: int | None = None) -> DataFrame:
    """Max ``metric`` among all rows, or the ``newest`` newest; the newest row when no metric is present."""
    recent = reg if newest is None else reg.orderBy(F.col("timestamp").desc(), "file_name").limit(newest)
    ranked = recent.select("*", F.row_number().over(
        Window.orderBy(F.col(metric).desc_nulls_last(), F.col("timestamp").desc(), "file_name")).alias("_rn"))
    return ranked.filter("_rn = 1").drop("_rn")
