"""Registered queries for the full feature table, bar resampling/streaming, persistence and MLlib.

Only ``resample_bars`` has SQL; the others write files, train models or run streams, and are checked
on row counts (plus the unit tests).
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.functions.series import rnd
from barlens.operators import clean as CL
from barlens.operators import labels as L
from barlens.operators import models as MD
from barlens.operators import registry as RG
from barlens.operators import select as SE
from barlens.operators import split as S
from barlens.operators.features.engineer import engineer
from barlens.plans.analytics_queries import FEATURES, signal_frame, signals
from barlens.session import scratch_path
from barlens.sources import bars as SB
from barlens.sources import store as ST
from barlens.streaming import bars as STR


def feature_merge(spark, sf):
    """Every family merged (first duplicate wins), relative to the as-of weekday benchmark, then the
    reference fill chain."""
    b = SB.bars(spark, sf, "p_type")
    bench = SB.as_benchmark(SB.market_gappy(spark, sf))
    return rnd(engineer(b, bench, block_rows=1024))


def resample_bars(spark, sf):
    return rnd(SB.event_bars(spark, sf), keep=("ticker", "bar_start"))


def stream_bars(spark, sf):
    bars = STR.stream_bars(spark, sf)
    return rnd(bars.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz")), keep=("ticker", "bar_start"))


def stream_dedup(spark, sf):
    return STR.stream_dedup(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _run_dir(spark, name):
    return scratch_path(spark, "runs", name, uuid.uuid4().hex[:12])


def write_bars(spark, sf):
    path = _run_dir(spark, "bars")
    ST.write_bars(SB.bars(spark, sf, "p_brand"), path)
    # a second write of two tickers replaces only their partitions
    two = SB.bars(spark, sf, "p_brand").filter(F.col("ticker").isin("Brand#11", "Brand#12"))
    ST.write_bars(two, path)
    return rnd(ST.read_bars(spark, path))


def write_processed(spark, sf):
    root = _run_dir(spark, "processed")
    f = signal_frame(spark, sf)
    ST.write_processed(f.select("ticker", "date", *FEATURES), f.select("ticker", "date", "outperforms"), root,
                       version="20240101_000000")
    return rnd(spark.read.parquet(f"{root}/processed_data_features/version=20240101_000000"))


def read_processed(spark, sf):
    root = _run_dir(spark, "processed")
    f = signal_frame(spark, sf)
    ST.write_processed(f.select("ticker", "date", *FEATURES), f.select("ticker", "date", "outperforms"), root,
                       version="20240101_000000")
    feats, labs = ST.read_processed(spark, root)
    return rnd(feats.join(labs, ["ticker", "date"]))


def latest_version(spark, sf):
    """A training set per calendar year of bars; the last year has no labels yet, so it is not a pair."""
    root = _run_dir(spark, "versions")
    b = SB.market_bars(spark, sf).select("date", "close", F.year("date").alias("year"))
    years = sorted(r.year for r in b.select("year").distinct().collect())  # calendar years
    for y in years:
        one = b.filter(F.col("year") == y).select("date", "close")
        ST.write_set(one, root, "training", "features", f"{y}1231_000000")
        if y < years[-1]:
            ST.write_set(one.select("date"), root, "training", "labels", f"{y}1231_000000")
    return ST.latest_version(spark, root)


# ---- MLlib ------------------------------------------------------------------------------------------

def training_frame(spark, sf, as_of=None, min_rows=50):
    """(table, feature columns): the whole engineered feature table, median-filled per split and scaled by the
    training rows, with ``outperforms`` and ``split``; and, as split ``score``, the newest bar up to ``as_of``
    (default: all) of every series with at least ``min_rows`` bars.  ``last_price`` is the unscaled close.

    Features keep their warm-up nulls (no backward fill, which would leak later values) until the fill; a
    column without any training value becomes 0.  The table is written once to the shared folder per application
    and state of the input files; every fit and every later query reads that set."""
    source = ST.fingerprint(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet")
    path = scratch_path(spark, "training", spark.sparkContext.applicationId, f"{source}-{as_of}-{min_rows}")
    if not ST.exists(spark, f"{path}/_SUCCESS"):
        t, scale = _training_table(spark, sf, as_of, min_rows)
        rows = spark.createDataFrame([(c, *v) for c, v in scale.items()], "feature string, mean double, sigma double")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}-scale")  # a row per column, before the table it belongs to
        t.write.mode("overwrite").parquet(path)
    t = spark.read.parquet(path)
    return t, [c for c in t.columns if c not in _NOT_FEATURES]


def training_scale(spark, sf, as_of=None, min_rows=50):
    """``feature -> (mean, sigma)`` that the table of ``training_frame`` is scaled by."""
    training_frame(spark, sf, as_of, min_rows)
    source = ST.fingerprint(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet")
    rows = spark.read.parquet(scratch_path(spark, "training", spark.sparkContext.applicationId, f"{source}-{as_of}-{min_rows}-scale"))
    return {r["feature"]: (r["mean"], r["sigma"]) for r in rows.collect()}  # a row per column


_NOT_FEATURES = ("ticker", "date", "last_price", "n_rows", "outperforms", "split")


def _training_table(spark, sf, as_of, min_rows):
    b, market = SB.bars_and_market(spark, sf, "p_type", end=as_of)
    bench = SB.as_benchmark(market.filter(F.weekday("date") < 5))
    f = engineer(b, bench, fill_mode="none")
    feats = [c for c in f.columns if c not in ("ticker", "date")]
    f = f.select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in feats], F.col("close").alias("last_price"),
                 F.count("*").over(Window.partitionBy("ticker")).alias("n_rows"),
                 F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc())).alias("_nth"))
    lab = S.chrono_split(L.labels(b, market)).select("ticker", "date", "outperforms", "split")
    newest = (F.col("_nth") == 1) & (F.col("n_rows") >= min_rows)
    t = f.join(lab, ["ticker", "date"], "left").withColumn("split", F.coalesce("split", F.when(newest, "score")))
    t = CL.inf_to_null(t.filter("split is not null").drop("_nth"), feats).checkpoint(eager=True)
    med = t.filter("split <> 'score'").groupBy("split").agg(*[F.percentile_approx(c, 0.5).alias(f"m_{c}") for c in feats])
    t = t.join(F.broadcast(med), "split", "left")  # three rows
    u = t.select("ticker", "date", "last_price", "n_rows", "outperforms", "split", *[F.coalesce(c, f"m_{c}").alias(c) for c in feats])
    scale = SE.fit_scale(u, feats, F.col("split") == "train")
    return SE.apply_scale(u, scale).fillna(0.0, feats), scale


def newest_rows(spark, sf, as_of=None, min_rows=50):
    """The newest bar and its signals of every series with at least ``min_rows`` bars up to ``as_of``
    (default: all bars), whether or not the bar has a label yet."""
    b = SB.bars(spark, sf, "p_type", end=as_of)
    n = b.groupBy("ticker").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= min_rows)
    return MD.latest_rows(signals(b)).join(n, "ticker")


def score_rows(spark, sf, as_of=None):
    """What ``score_universe`` scores: series, prediction date, last price and raw signals."""
    t = newest_rows(spark, sf, as_of)
    t = t.select("ticker", F.col("date").alias("prediction_date"), F.col("close").alias("last_price"), "n_rows", *FEATURES)
    return rnd(t, keep=("ticker", "prediction_date", "n_rows"))


def _train_one(name):
    def run(spark, sf):
        f, feats = training_frame(spark, sf)
        m = MD.fit(name, f.filter("split = 'train'"), feats)
        return MD.evaluate(m, f.filter("split = 'test'"), name)
    run.__name__ = f"train_{name}"
    return run


def train_all(spark, sf):
    f, feats = training_frame(spark, sf)
    out, _ = MD.train_all(f.filter("split = 'train'"), f.filter("split = 'test'"), feats, val=f.filter("split = 'val'"))
    return out


def tune(spark, sf):
    f, feats = training_frame(spark, sf)
    cv = MD.tune(f.filter("split = 'train'"), feats, "logistic_regression", folds=5)
    maps = cv.getEstimatorParamMaps()
    rows = [(str({p.name: v for p, v in m.items()}), float(a)) for m, a in zip(maps, cv.avgMetrics)]  # one row per grid point
    return spark.createDataFrame(rows, "params string, mean_auc double")


def feature_importance(spark, sf):
    f, feats = training_frame(spark, sf)
    return MD.feature_importance(MD.fit("random_forest", f.filter("split = 'train'"), feats), feats)


def rfe(spark, sf, keep=50, step=1):
    """The ``keep`` features that recursive elimination leaves, ``step`` of the others going at each refit."""
    f, feats = training_frame(spark, sf)
    kept = MD.rfe(f.filter("split = 'train'"), feats, keep, step=step)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def top_importance(spark, sf, n=20):
    """The features a trained forest leans on most."""
    return MD.top_features(feature_importance(spark, sf), n)


#: sizes that a universe is cut into, the last being all of it
SCALING_STEPS = 3


def _scaling_sizes(series, steps=SCALING_STEPS):
    """``steps`` growing universe sizes up to all ``series`` (fewer if there are fewer series)."""
    return sorted({-(-series * i // steps) for i in range(1, steps + 1)} - {0})


def saved_models(spark, sf, sizes=None, names=MD.MODEL_NAMES):
    """Train every model on universes of growing size (the first n series; by default thirds of all), save each one and
    list the registry."""
    f, feats = training_frame(spark, sf)
    root = _run_dir(spark, "models")
    universe = SB.universe(spark, sf, "p_type")
    todo = []
    for n in sorted(_scaling_sizes(universe.count()) if sizes is None else sizes, reverse=True):  # the longest fits start first
        part = f.join(universe.where(F.col("ordinal") <= n).select("ticker"), "ticker", "leftsemi")
        train, test = part.filter("split = 'train'"), part.filter("split = 'test'")
        table, rows = MD.fit_table(train, feats), train.count()
        todo += [(n, name, rows, partial(_fitted, name, table, feats, rows, test)) for name in names]
    todo.sort(key=lambda t: t[1] in MD.LINEAR)
    for (n, name, rows, _), got in zip(todo, MD.fit_each([job for *_, job in todo]), strict=True):
        if isinstance(got, Exception):
            raise got
        model, metrics = got
        MD.save_model(model, f"{root}/{name}_{n}stocks_v1.model", f"{root}/registry", name, metrics, len(feats), rows, n)
    return MD.list_models(spark, f"{root}/registry")


def _fitted(name, table, feats, rows, test):
    """(model, metrics): the fit and its measured row of metrics, so that measuring runs side by side too."""
    model = MD.fit_on(name, table, feats, rows)
    metrics = MD.evaluate(model, test, name)
    return model, metrics.sparkSession.createDataFrame(metrics.collect(), metrics.schema)  # one row


def train_scaling(spark, sf):
    """Models trained anew for each universe size, compared through the registry of saved models."""
    return RG.scaling_report(saved_models(spark, sf))


def model_save_load(spark, sf):
    f, feats = training_frame(spark, sf)
    train = f.filter("split = 'train'")
    m = MD.fit("logistic_regression", train, feats)
    root = _run_dir(spark, "models")
    metrics = MD.evaluate(m, f.filter("split = 'test'"), "logistic_regression")
    MD.save_model(m, f"{root}/logistic_regression_6stocks_v1.model", f"{root}/registry", "logistic_regression", metrics,
                  len(feats), train.count())
    loaded = MD.load_model(f"{root}/logistic_regression_6stocks_v1.model")
    return MD.score(loaded, f.filter("split = 'test'")).select("ticker", "date", "prob", "pred")


def score_universe(spark, sf, as_of=None):
    """The newest bar of every series as of a date, scored by a model of the training rows."""
    f, feats = training_frame(spark, sf, as_of)
    train = f.filter("split = 'train'")
    m = MD.fit("logistic_regression", train, feats)
    bounds = MD.feature_bounds(train, feats)
    return MD.score_universe(m, f.filter("split = 'score'"), feats, "logistic_regression", price="last_price", bounds=bounds)


def score_no_benchmark(spark, sf, as_of=None, min_rows=50):
    """``score_universe`` when no benchmark can be had: the model is the same, the newest rows are engineered from the
    series alone, and what needs the benchmark is 0 before scaling."""
    f, feats = training_frame(spark, sf, as_of, min_rows)
    train = f.filter("split = 'train'")
    m = MD.fit("logistic_regression", train, feats)
    bars = SB.bars(spark, sf, "p_type", end=as_of)
    long = bars.groupBy("ticker").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= min_rows).select("ticker")
    alone = engineer(bars, fill_mode="none")
    newest = MD.latest_rows(alone).join(long, "ticker", "leftsemi").withColumn("last_price", F.col("close"))
    newest = CL.inf_to_null(newest, alone.columns).checkpoint(eager=True)  # a row per series
    rows = SE.model_rows(newest, feats, training_scale(spark, sf, as_of, min_rows), ["ticker", "date", "last_price"])
    return MD.score_universe(m, rows, feats, "logistic_regression", price="last_price", bounds=MD.feature_bounds(train, feats))


QUERIES = {
    "feature_merge": feature_merge, "resample_bars": resample_bars, "stream_bars": stream_bars,
    "stream_dedup": stream_dedup, "write_bars": write_bars, "write_processed": write_processed,
    "read_processed": read_processed, "latest_version": latest_version,
    "train_logistic": _train_one("logistic_regression"), "train_elasticnet": _train_one("elastic_net"),
    "train_ridge": _train_one("ridge"), "train_random_forest": _train_one("random_forest"),
    "train_gbt": _train_one("gradient_boosting"), "train_svm": _train_one("svm"), "train_mlp": _train_one("mlp"),
    "train_all": train_all, "tune": tune, "feature_importance": feature_importance, "rfe": rfe,
    "top_importance": top_importance, "saved_models": saved_models, "train_scaling": train_scaling,
    "model_save_load": model_save_load, "score_universe": score_universe, "score_no_benchmark": score_no_benchmark, "score_rows": score_rows,
}
