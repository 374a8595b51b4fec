"""Registered queries: reports, selection, metrics, registry/leaderboards, quality monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.functions.series import div, lag, pct, rnd, round_half_away, sma, std
from barlens.operators import clean as CL
from barlens.operators import labels as L
from barlens.operators import metrics as ME
from barlens.operators import registry as RG
from barlens.operators import reports as RP
from barlens.operators import select as SE
from barlens.operators import split as S
from barlens.operators.features.engineer import engineer
from barlens.plans.feature_queries import ENGINEERED_COLS
from barlens.session import scratch_path
from barlens.sources import bars as SB
from barlens.sources import store as ST

FEATURES = ["momentum_20", "rs_sma_20", "price_ma_position_20", "price_zscore_20", "volume_ratio", "volatility_20"]
SIGNALS = ["momentum_20", "rs_sma_20", "price_zscore_20", "volume_ratio", "volatility_20"]
SIZES = [2, 4, 6]


def signals(bars: DataFrame) -> DataFrame:
    """The signal columns of every bar."""
    s20 = sma("close", 20)
    t = bars.select("ticker", "date", "close", "volume",
                    (div("close", lag("close", 20)) - 1).alias("momentum_20"),
                    div(F.col("close") - s20, s20).alias("rs_sma_20"),
                    div(F.col("close") - s20, s20).alias("price_ma_position_20"),
                    div(F.col("close") - s20, std("close", 20)).alias("price_zscore_20"),
                    div("volume", sma("volume", 20)).alias("volume_ratio"),
                    pct("close", 1).alias("_r"))
    return t.select("*", std("_r", 20).alias("volatility_20")).drop("_r")


def signal_frame(spark: SparkSession, sf: str, materialize: bool = True) -> DataFrame:
    """A compact feature table joined to labels and split chronologically (p_type universe).

    The result is bars-sized (one row per ticker and date) while its lineage scans the trade table
    several times (bars, market, split counts).  Queries over it run several jobs (quantile bounds,
    scalar subqueries, the main job), so it is checkpointed once into the shared checkpoint folder:
    every later job reads that file instead of rescanning the trades, and survives executor loss."""
    b = SB.bars(spark, sf, "p_type")
    lab = L.labels(b, SB.market_bars(spark, sf))
    out = S.chrono_split(signals(b).join(lab, ["ticker", "date"]))
    if not materialize:
        return out
    from barlens.session import checkpoint_dir

    checkpoint_dir(spark)  # the cluster's spark.checkpoint.dir; a scratch folder only when unset
    return out.checkpoint(eager=True)


def feature_frame(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """(table, feature columns): the whole engineered feature table with its warm-up nulls, ``outperforms`` and ``split``, written once
    to the shared folder per application and state of the input files."""
    source = ST.fingerprint(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet")
    path = scratch_path(spark, "features", spark.sparkContext.applicationId, source)
    if not ST.exists(spark, f"{path}/_SUCCESS"):
        b, market = SB.bars_and_market(spark, sf, "p_type")
        f = engineer(b, SB.as_benchmark(market.filter(F.weekday("date") < 5)), fill_mode="none")
        lab = S.chrono_split(L.labels(b, market)).select("ticker", "date", "outperforms", "split")
        f.join(lab, ["ticker", "date"]).write.mode("overwrite").parquet(path)
    t = spark.read.parquet(path)
    return t, ENGINEERED_COLS


def _frame_rounded(df):
    return rnd(df, keep=("ticker", "date"))


# ---- reports ----------------------------------------------------------------------------------------

def risk_return(spark, sf):
    te = RP.trailing_excess(SB.bars(spark, sf, "p_type"), SB.market_bars(spark, sf))
    return rnd(RP.risk_return(te))


def annual_risk(spark, sf):
    return rnd(RP.annual_risk(SB.bars(spark, sf, "p_brand"), SB.market_bars(spark, sf)))


def top_sharpe(spark, sf, n=5):
    a = RP.annual_risk(SB.bars(spark, sf, "p_brand"), SB.market_bars(spark, sf))
    return rnd(a.orderBy(F.col("sharpe_ratio").desc(), "ticker").limit(n).select("ticker", "sharpe_ratio"))


def histogram(spark, sf, n=5, bins=50):
    """50-bin daily-return histograms of the 5 best-Sharpe series."""
    a = RP.annual_risk(SB.bars(spark, sf, "p_brand"), SB.market_bars(spark, sf))
    top = a.orderBy(F.col("sharpe_ratio").desc(), "ticker").limit(n).select("ticker")
    b = SB.bars(spark, sf, "p_brand")
    r = b.select("ticker", "date", pct("close", 1).alias("r")).join(F.broadcast(top), "ticker", "left_semi")
    return rnd(RP.histogram(r, "r", bins, "ticker"))


def max_drawdown(spark, sf):
    dd = RP.max_drawdown(SB.bars(spark, sf, "p_brand"))
    return rnd(dd.groupBy("ticker").agg(F.min("drawdown_pct").alias("max_drawdown"), F.max("cum_growth").alias("peak_growth")))


def sector_performance(spark, sf):
    perf = RP.ticker_performance(SB.sector_bars(spark, sf), 100)
    return rnd(RP.sector_performance(perf, SB.sector_dim(spark, sf)), keep=("sector",))


def ticker_performance(spark, sf):
    return rnd(RP.ticker_performance(SB.sector_bars(spark, sf), 100))


def box_stats(spark, sf):
    te = RP.trailing_excess(SB.bars(spark, sf, "p_type"), SB.market_bars(spark, sf))
    return rnd(RP.box_stats(te, "stock_return"))


def return_corr_matrix(spark, sf):
    return rnd(RP.return_corr_matrix(SB.bars(spark, sf, "p_type"), SB.market_bars(spark, sf)), keep=("a", "b"))


def rolling_vol_report(spark, sf):
    return rnd(RP.rolling_vol_report(SB.bars(spark, sf, "p_type"), SB.market_bars(spark, sf)))


def _target_corr(t, feats):
    """``feature, corr, abs_corr`` with the label, all columns in one pass."""
    m = SE.corr_matrix(t, [*feats, "outperforms"]).where("b = 'outperforms'")
    return m.select(F.col("a").alias("feature"), "corr", F.abs("corr").alias("abs_corr"))


def feature_corr_matrix(spark, sf, top_n=25):
    t, feats = feature_frame(spark, sf)
    # identical columns tie exactly; rank on |corr| rounded to 9 dp so an ulp cannot reorder them
    top = [r.feature for r in SE.select_top(_target_corr(t, feats), "abs_corr", top_n).collect()]
    return rnd(SE.corr_matrix(t, [c for c in feats if c in top] + ["outperforms"]), keep=("a", "b"))


def top_features(spark, sf, n=20):
    t, feats = feature_frame(spark, sf)
    return rnd(SE.select_top(_target_corr(t.filter("split = 'train'"), feats), "abs_corr", n), keep=("feature",))


# ---- selection / preparation -------------------------------------------------------------------------

def _train(spark, sf):
    return signal_frame(spark, sf).filter(F.col("split") == "train")


def _wide_train(spark, sf):
    t, feats = feature_frame(spark, sf)
    return t.filter(F.col("split") == "train"), feats


def corr_prune(spark, sf):
    return rnd(SE.corr_prune(*_wide_train(spark, sf)), keep=("feature",))


def f_score(spark, sf):
    return rnd(SE.f_score(*_wide_train(spark, sf)).select("feature", "n", "f_score"), keep=("feature",))


def f_score_top(spark, sf, n=50):
    return rnd(SE.select_top(SE.f_score(*_wide_train(spark, sf)), "f_score", n).select("feature", "n", "f_score"), keep=("feature",))


def mutual_info_top(spark, sf, n=50):
    return rnd(SE.select_top(SE.mutual_info_binned(*_wide_train(spark, sf)), "mutual_info", n), keep=("feature",))


def mutual_info(spark, sf):
    return rnd(SE.mutual_info_binned(*_wide_train(spark, sf)), keep=("feature",))


def mutual_info_ntile(spark, sf):
    """Bins of equal size: rows of equal value are dealt over bins by series and date."""
    return rnd(SE.mutual_info(_train(spark, sf), FEATURES), keep=("feature",))


def standardize(spark, sf):
    f = signal_frame(spark, sf).select("ticker", "date", "split", *FEATURES)
    return rnd(SE.standardize(f, FEATURES, F.col("split") == "train"))


def feature_null_ratio(spark, sf):
    f = signal_frame(spark, sf)
    return rnd(CL.feature_null_ratio(f, FEATURES), keep=("ticker", "feature"))


def bfill_features(spark, sf):
    f = signal_frame(spark, sf).select("ticker", "date", *FEATURES)
    return rnd(CL.bfill_features(f, FEATURES))


def median_impute(spark, sf):
    f = signal_frame(spark, sf).select("ticker", "date", *FEATURES)
    return rnd(CL.median_impute(f, FEATURES))


def drop_sparse_features(spark, sf):
    f = signal_frame(spark, sf).select("ticker", "date", "momentum_20",
                                       F.when(F.weekday("date") >= 5, F.col("close")).alias("weekend_close"),
                                       F.when(F.col("split") == "test", F.col("close")).alias("test_close"))
    return rnd(CL.drop_sparse_features(f, ["momentum_20", "weekend_close", "test_close"]))


def inf_to_null(spark, sf):
    f = signal_frame(spark, sf).select("ticker", "date", *FEATURES)
    return rnd(CL.inf_to_null(f, FEATURES))


def quality_report(spark, sf):
    return rnd(CL.quality_report(*feature_frame(spark, sf)), keep=("feature",))


def prepare_matrix(spark, sf):
    return rnd(SE.prepare_matrix(*_wide_train(spark, sf)))


def align_feature_columns(spark, sf):
    f = signal_frame(spark, sf).filter(F.col("split") == "test")
    return rnd(SE.align_feature_columns(f, ["volatility_20", "momentum_20", "adx_14", "rs_sma_20"], ["ticker", "date"]))


# ---- metrics -----------------------------------------------------------------------------------------

def _scored(spark, sf, score="rs_sma_20"):
    f = signal_frame(spark, sf)
    return f.select("ticker", "date", "split", F.col(score).alias("score"), F.col("outperforms").alias("label"),
                    (F.col(score) > 0).cast("int").alias("pred"), RG.squash(score).alias("prob")).filter(F.col("score").isNotNull())


def roc_auc(spark, sf):
    return rnd(ME.roc_auc(_scored(spark, sf)))


def class_metrics(spark, sf):
    return rnd(ME.class_metrics(_scored(spark, sf).filter("split = 'test'")))


def pr_curve(spark, sf):
    return rnd(ME.pr_curve(_scored(spark, sf).filter("split = 'test'")))


def avg_precision(spark, sf):
    return rnd(ME.avg_precision(ME.pr_curve(_scored(spark, sf).filter("split = 'test'"))))


def calibration(spark, sf):
    return rnd(ME.calibration(_scored(spark, sf).filter("split = 'test'")))


def histogram_probs(spark, sf, bins=30):
    """30-bin histogram of the predicted probabilities on the test split."""
    return rnd(RP.histogram(_scored(spark, sf).filter("split = 'test'"), "prob", bins), keep=("bin",))


def validate_predictions(spark, sf):
    s = _scored(spark, sf).filter("split = 'test'")
    return s.select("ticker", "date", F.col("pred").alias("predicted"), F.col("label").alias("actual"),
                    (F.col("pred") == F.col("label")).alias("correct"))


def top_predictions(spark, sf, min_conf=0.55, n=50):
    f = SB.bars(spark, sf, "p_brand")
    s20 = sma("close", 20)
    t = f.select("ticker", "date", "close", div(F.col("close") - s20, s20).alias("rs"))
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    last = t.filter(F.col("rs").isNotNull()).select("*", F.row_number().over(w).alias("_rn")).filter("_rn = 1")
    p = last.select("ticker", F.col("date").alias("prediction_date"), RG.squash("rs").alias("outperform_probability"),
                    F.col("close").alias("last_price"))
    p = p.select("*", (F.col("outperform_probability") > 0.5).alias("prediction"),
                 F.greatest(F.col("outperform_probability"), 1 - F.col("outperform_probability")).alias("confidence"))
    p = p.filter(F.col("prediction") & (F.col("confidence") >= min_conf))
    return rnd(p.orderBy(F.col("outperform_probability").desc(), "ticker").limit(n), keep=("ticker", "prediction_date"))


def ks_drift(spark, sf):
    t, feats = feature_frame(spark, sf)
    f = t.filter(F.col("split").isin("train", "test")).withColumn("sample", F.expr("int(split = 'test')"))
    return rnd(ME.ks_drift(SE.to_long(f, feats, ["sample"])), keep=("feature",))


# ---- registry / leaderboards ---------------------------------------------------------------------------

def _registry(spark, sf):
    long = RG.signal_long(signal_frame(spark, sf), SIGNALS, SIZES, SB.universe(spark, sf, "p_type"))
    return RG.registry(long)


def registry(spark, sf):
    return rnd(_registry(spark, sf), keep=("file_name",))


def registry_scan(spark, sf):
    return rnd(RG.registry_scan(_registry(spark, sf)), keep=("file_name",))


def leaderboard_by_type(spark, sf):
    return rnd(RG.leaderboard_by_type(_registry(spark, sf)), keep=("model_name",))


def best_per_group(spark, sf):
    return rnd(RG.best_per_group(_registry(spark, sf)), keep=("file_name",))


def best_per_metric(spark, sf):
    return rnd(RG.best_per_metric(_registry(spark, sf)), keep=("metric",))


def best_model_counts(spark, sf):
    return RG.best_model_counts(_registry(spark, sf))


def scaling_report(spark, sf):
    return rnd(RG.scaling_report(_registry(spark, sf)), keep=("stocks_count",))


def best_model(spark, sf):
    return rnd(RG.best_model(_registry(spark, sf)), keep=("file_name",))


def latest_model(spark, sf):
    return rnd(RG.latest_models(_registry(spark, sf), 3), keep=("file_name",))


def perf_gate(spark, sf):
    return rnd(ME.perf_gate(_registry(spark, sf)).select("file_name", "accuracy", "auc", "precision", "needs_retrain"),
               keep=("file_name",))


def cache_compat(spark, sf):
    cached = SB.bars(spark, sf, "p_brand", start="1996-01-01", end="1999-12-31")
    req = SB.bars(spark, sf, "p_brand", start="1997-01-01", end="2000-12-31")
    return rnd(CL.cache_compat(cached, req))


def source_quality(spark, sf):
    return rnd(CL.source_quality(SB.bars(spark, sf, "p_brand"), "2001-11-05"))


QUERIES = {
    "risk_return": risk_return, "annual_risk": annual_risk, "top_sharpe": top_sharpe, "histogram": histogram,
    "max_drawdown": max_drawdown, "sector_performance": sector_performance, "ticker_performance": ticker_performance,
    "box_stats": box_stats, "return_corr_matrix": return_corr_matrix, "rolling_vol_report": rolling_vol_report,
    "feature_corr_matrix": feature_corr_matrix, "top_features": top_features,
    "corr_prune": corr_prune, "f_score": f_score, "mutual_info": mutual_info, "f_score_top": f_score_top, "mutual_info_top": mutual_info_top, "mutual_info_ntile": mutual_info_ntile, "standardize": standardize,
    "feature_null_ratio": feature_null_ratio, "bfill_features": bfill_features, "median_impute": median_impute,
    "drop_sparse_features": drop_sparse_features, "inf_to_null": inf_to_null, "quality_report": quality_report,
    "prepare_matrix": prepare_matrix, "align_feature_columns": align_feature_columns,
    "roc_auc": roc_auc, "class_metrics": class_metrics, "pr_curve": pr_curve, "avg_precision": avg_precision,
    "calibration": calibration, "validate_predictions": validate_predictions, "histogram_probs": histogram_probs, "top_predictions": top_predictions,
    "ks_drift": ks_drift,
    "registry": registry, "registry_scan": registry_scan, "leaderboard_by_type": leaderboard_by_type,
    "best_per_group": best_per_group, "best_per_metric": best_per_metric, "best_model_counts": best_model_counts,
    "scaling_report": scaling_report, "best_model": best_model, "latest_model": latest_model, "perf_gate": perf_gate,
    "cache_compat": cache_compat, "source_quality": source_quality,
}
