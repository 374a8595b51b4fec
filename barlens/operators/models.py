"""MLlib training, tuning, importance, scoring and model persistence.

Model fitting is MLlib's distributed optimisers (treeAggregate gradients / distributed tree
induction); evaluation reuses the distributed metric operators.  Hyper-parameters follow the
reference configuration, mapped to MLlib's parameterisation where the objectives differ by scale.
"""

from __future__ import annotations

import datetime as _dt
import math
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.operators.logistic import NewtonLogisticRegression
from barlens.operators.metrics import class_metrics, roc_auc
from barlens.operators.trees import binned, forest_importances
from barlens.session import checkpoint_dir

SEED = 42
LABEL = "outperforms"

# Fixed hyper-parameters of the reference model configuration.
LOGISTIC_C = 1.0
ELASTICNET_ALPHA, ELASTICNET_L1 = 1e-4, 0.5
RIDGE_ALPHA = 1.0
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 100, 10, 2
GBT_ITERS, GBT_LR, GBT_DEPTH, GBT_SUBSAMPLE = 100, 0.1, 6, 0.8
MLP_LAYERS = (100, 50)
RFE_TREES = 50
TUNE_TOL = 1e-4

#: cells (rows x features) of a linear fit's task: 16 MB of doubles, some milliseconds a pass
LINEAR_CELLS = 2_000_000

#: fits that run side by side where several models are trained
FITS_AT_ONCE = 4

#: depth of the trees that rank features for elimination (the reference grows them without bound)
RFE_DEPTH = 5


def estimator(name: str, n_features: int, n_rows: int):
    """The MLlib estimator standing for one reference model name."""
    if name == "logistic_regression":
        return NewtonLogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (LOGISTIC_C * max(n_rows, 1)),
                                        elasticNetParam=0.0, standardization=False, maxIter=1000)
    if name == "elastic_net":
        return NewtonLogisticRegression(featuresCol="features", labelCol="label", regParam=ELASTICNET_ALPHA,
                                        elasticNetParam=ELASTICNET_L1, standardization=False, maxIter=1000)
    if name == "ridge":
        return LinearRegression(featuresCol="features", labelCol="label_pm", regParam=RIDGE_ALPHA / max(n_rows, 1),
                                elasticNetParam=0.0, standardization=False)
    if name == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=RF_TREES, maxDepth=RF_DEPTH,
                                      minInstancesPerNode=RF_MIN_LEAF, seed=SEED)
    if name == "gradient_boosting":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=GBT_ITERS, stepSize=GBT_LR,
                             maxDepth=GBT_DEPTH, subsamplingRate=GBT_SUBSAMPLE, seed=SEED)
    if name == "svm":
        return LinearSVC(featuresCol="features", labelCol="label", regParam=1.0 / max(n_rows, 1), standardization=False)
    if name == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                              layers=[n_features, *MLP_LAYERS, 2], seed=SEED, maxIter=200)
    raise ValueError(f"unknown model {name}")


MODEL_NAMES = ["logistic_regression", "elastic_net", "ridge", "random_forest", "gradient_boosting", "svm", "mlp"]
LINEAR = {"logistic_regression", "elastic_net", "ridge", "svm"}
SCALED = {"logistic_regression", "elastic_net", "ridge", "svm", "mlp"}


def training_table(df: DataFrame, features: list[str]) -> DataFrame:
    """label (double), label_pm (+-1 for ridge) and the assembled feature vector."""
    t = df.select("*", F.col(LABEL).cast("double").alias("label"),
                  (F.col(LABEL).cast("double") * 2.0 - 1.0).alias("label_pm"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(t)


def fit_matrix(table: DataFrame, columns: list[str], per_task: int | None = None) -> DataFrame:
    """``columns`` of an assembled training table, checkpointed: an optimiser runs hundreds of small jobs, and each of them
    would ship the lineage of a table 168 columns wide.  ``per_task``: cells that make a task's share where a pass over the
    rows is cheap, as in linear models; smaller partitions only add tasks to every iteration.  The number of tasks grows
    with the table."""
    checkpoint_dir(table.sparkSession)
    t = table.select(*columns).checkpoint(eager=True)
    return t if per_task is None else in_shares(t, per_task)


def in_shares(matrix: DataFrame, per_task: int) -> DataFrame:
    """A checkpointed matrix in tasks of about ``per_task`` cells."""
    size = matrix.agg(F.count("*").alias("rows"), F.max(F.size(vector_to_array("features"))).alias("width")).first()
    return matrix.coalesce(max(1, math.ceil(size["rows"] * (size["width"] or 1) / per_task)))


def fit_table(train: DataFrame, features: list[str]) -> DataFrame:
    """The matrix that fits of any model read, written once."""
    return fit_matrix(training_table(train, features), ["label", "label_pm", "features"])


def fit_on(name: str, table: DataFrame, features: list[str], n_rows: int) -> PipelineModel:
    """``fit`` over a ``fit_table``."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    matrix = in_shares(table, LINEAR_CELLS) if name in LINEAR else table
    return PipelineModel([assembler, estimator(name, len(features), n_rows).fit(matrix)])


def fit(name: str, train: DataFrame, features: list[str], n_rows: int | None = None) -> PipelineModel:
    n = train.count() if n_rows is None else n_rows
    return fit_on(name, fit_table(train, features), features, n)


def fit_each(jobs: list, parallelism: int = FITS_AT_ONCE) -> list:
    """The results of ``jobs`` (functions without arguments), in their order; a job that failed gives its exception.  A fit's
    small jobs leave most of a cluster idle, so several fits share it, like the candidates of ``CrossValidator``."""
    def run(job):
        try:
            return job()
        except Exception as e:  # noqa: BLE001 -- the caller says what a failure means
            return e

    with ThreadPool(min(parallelism, max(1, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(run), jobs, chunksize=1)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prob`` (P(outperform); the ridge score is squashed through its sign distance) and
    ``pred``; classifiers without probabilities use their raw margin as the ranking score."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        r = vector_to_array("rawPrediction")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(r[0] - r[1]))
    else:  # ridge regression on +-1 targets
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("prediction")))
    return out.select(*df.columns, p.alias("prob")).select("*", (F.col("prob") > 0.5).cast("int").alias("pred"))


def evaluate(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    s = score(model, df).select(F.lit(name).alias("model_name"), F.col("prob").alias("score"), F.col(LABEL).alias("label"), "pred")
    a = roc_auc(s, keys=["model_name"]).select("model_name", "auc")
    c = class_metrics(s, keys=["model_name"]).select("model_name", "accuracy", "precision", "recall", "f1_score")
    return a.join(c, "model_name")


def train_all(train: DataFrame, test: DataFrame, features: list[str], names=MODEL_NAMES,
              val: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Fit every named model (a failure is a row with its ``error``, not raised); returns (table, models).

    Metrics are those of ``test``.  With ``val``, ``val_auc`` is the AUC there and ``is_best`` marks the
    model that is best by it (ties by name), so the choice does not see the test rows."""
    spark = train.sparkSession
    n_rows = train.count()
    out = spark.createDataFrame([], "model_name string, auc double, accuracy double, precision double, recall double, f1_score double, error string")
    models, val_auc = {}, {}
    fits = fit_each([partial(fit, n, train, features, n_rows) for n in names])
    for n, m in zip(names, fits, strict=True):
        try:
            if isinstance(m, Exception):
                raise m
            models[n] = m
            row = evaluate(m, test, n)
            if val is not None:
                s = score(m, val).select(F.col("prob").alias("score"), F.col(LABEL).alias("label"))
                val_auc[n] = roc_auc(s).first()["auc"]  # one number per model
            out = out.unionByName(row, allowMissingColumns=True)
        except Exception as e:  # noqa: BLE001 -- a failing model is skipped like in the reference
            failed = spark.createDataFrame([(n, repr(e)[:200])], "model_name string, error string")
            out = out.unionByName(failed, allowMissingColumns=True)
    if val is not None:
        table = spark.createDataFrame(list(val_auc.items()), "model_name string, val_auc double")
        best = min((n for n, a in val_auc.items() if a is not None), key=lambda n: (-val_auc[n], n), default=None)
        out = out.join(table, "model_name", "left").withColumn("is_best", F.col("model_name").eqNullSafe(F.lit(best)))
    return out, models


def feature_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Tree models: ``featureImportances``; linear models: |coefficient|.  One row per feature."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        v = m.featureImportances.toArray().tolist()
    else:
        v = [abs(x) for x in m.coefficients.toArray().tolist()]
    from pyspark.sql import SparkSession

    # one value per feature column: model metadata, not data
    return SparkSession.getActiveSession().createDataFrame(list(zip(features, [float(x) for x in v])), "feature string, importance double")


def top_features(imp: DataFrame, n: int = 20) -> DataFrame:
    return imp.orderBy(F.col("importance").desc(), "feature").limit(n)


def rfe(train: DataFrame, features: list[str], keep: int, step: int = 1, trees: int = RFE_TREES, depth: int = RFE_DEPTH) -> list[str]:
    """Recursive elimination: refit a random forest and drop the least important feature(s), ties by name.

    The features are assembled and binned once; every refit grows its forest on the bins of the features that are left, the
    slice of the vector that a ``VectorSlicer`` names."""
    matrix = fit_matrix(training_table(train, features), ["label", "features"])
    cur = list(range(len(features)))
    with binned(matrix, trees, SEED) as rows:
        while len(cur) > keep:
            left = VectorSlicer(inputCol="features", outputCol="slice", indices=cur).getIndices()
            weight = forest_importances(rows, left, trees, depth, SEED)
            order = sorted(range(len(cur)), key=lambda k: (weight[k], features[cur[k]]))
            gone = {cur[k] for k in order[: min(step, len(cur) - keep)]}
            cur = [c for c in cur if c not in gone]
    return [features[c] for c in cur]


def tune(train: DataFrame, features: list[str], name: str = "logistic_regression", folds: int = 5, parallelism: int = 4):
    """Grid search with k-fold cross-validation on ROC AUC (MLlib CrossValidator).  The feature vector is assembled once
    and checkpointed; the folds read it.  Returns the fitted CrossValidatorModel, whose best model takes ``features``."""
    n = train.count()
    est = estimator(name, len(features), n)
    grid = ParamGridBuilder()
    if name == "logistic_regression":
        # C in {0.1, 1, 10} x penalty {l1, l2} -> regParam = 1/(C n), elasticNet 1 or 0 (the reference's
        # solver axis selects an optimiser, not a different model, so it has no MLlib counterpart); its solvers
        # stop at a tolerance of 1e-4
        est = est.setTol(TUNE_TOL)
        grid = grid.addGrid(est.regParam, [1.0 / (c * n) for c in (0.1, 1.0, 10.0)]).addGrid(est.elasticNetParam, [0.0, 1.0])
    elif name == "random_forest":
        # min_samples_split has no MLlib equivalent; leaf size maps to minInstancesPerNode
        grid = grid.addGrid(est.numTrees, [50, 100, 200]).addGrid(est.maxDepth, [5, 10, 15]).addGrid(est.minInstancesPerNode, [1, 2, 4])
    elif name == "gradient_boosting":
        grid = grid.addGrid(est.maxIter, [50, 100, 200]).addGrid(est.stepSize, [0.01, 0.1, 0.2]).addGrid(est.maxDepth, [3, 5, 7])
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid.build(), numFolds=folds, parallelism=parallelism, seed=SEED, foldCol="fold",
                        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"))
    # the folds CrossValidator itself would draw, written down before the rows are dealt anew
    fold = F.least(F.floor(F.rand(SEED) * folds), F.lit(folds - 1)).cast("int")
    table = training_table(train, features).select("label", "features").withColumn("fold", fold)
    return cv.fit(fit_matrix(table, ["label", "features", "fold"], LINEAR_CELLS if name in LINEAR else None))


REGISTRY = ("file_name string, model_name string, stocks_count int, timestamp string, training_date string, feature_count int, file_size_mb double, "
            "auc double, accuracy double, precision double, recall double, f1_score double, training_samples bigint, hyperparameter_tuning boolean")


def save_model(model: PipelineModel, path: str, registry_path: str, name: str, metrics: DataFrame | None,
               n_features: int, n_train: int, stocks: int | None = None, tuned: bool = False) -> None:
    """Persist the fitted pipeline, then publish its registry row (one parquet row): what the registry lists is
    complete, also when a job ends between the two."""
    spark = SparkSession.getActiveSession() if metrics is None else metrics.sparkSession
    model.write().overwrite().save(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength() / 1e6
    now = _dt.datetime.now(_dt.timezone.utc)
    names = ["auc", "accuracy", "precision", "recall", "f1_score"]
    got = metrics.where(F.col("model_name") == name).first() if metrics is not None else None
    row = (path.rstrip("/").split("/")[-1], name, stocks, now.strftime("%Y%m%d_%H%M%S"), now.date().isoformat(), n_features, float(size),
           *[got[m] if got is not None else None for m in names], n_train, tuned)
    spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").parquet(registry_path)


def list_models(spark: SparkSession, registry_path: str) -> DataFrame:
    """The saved models, best AUC first: of several saves under one file name the newest, with ``is_best_model``."""
    rows = spark.read.schema(REGISTRY).parquet(registry_path)
    newest = Window.partitionBy("file_name").orderBy(F.col("timestamp").desc(), F.col("auc").desc_nulls_last())
    rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    best = Window.orderBy(F.col("auc").desc_nulls_last(), "file_name")  # one row per model
    return rows.withColumn("is_best_model", F.row_number().over(best) == 1).orderBy(F.col("auc").desc_nulls_last(), "file_name")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def latest_rows(features: DataFrame, key: str = "ticker") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("date").desc())
    return features.select("*", F.row_number().over(w).alias("_rn")).filter("_rn = 1").drop("_rn")


def feature_bounds(train: DataFrame, features: list[str]) -> DataFrame:
    """``feature, lo, hi``: the range of every feature over the training rows (one row per column)."""
    cells = ", ".join(f"named_struct('feature', '{c}', 'lo', double(min(`{c}`)), 'hi', double(max(`{c}`)))" for c in features)
    return train.agg(F.expr(f"array({cells})").alias("b")).selectExpr("inline(b)")


def within_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``df`` with every feature clipped to its training range, and ``features_clipped``: how many were outside."""
    span = {r["feature"]: (r["lo"], r["hi"]) for r in bounds.collect() if r["lo"] is not None}  # a row per column
    out = ["0"] + [f"int(`{c}` < double('{lo!r}') OR `{c}` > double('{hi!r}'))" for c, (lo, hi) in span.items()]
    clip = [f"least(greatest(`{c}`, double('{span[c][0]!r}')), double('{span[c][1]!r}')) AS `{c}`" if c in span else f"`{c}`" for c in df.columns]
    return df.selectExpr(*clip, f"aggregate(array({', '.join(out)}), 0, (a, x) -> a + coalesce(x, 0)) AS features_clipped")


def score_universe(model: PipelineModel, features: DataFrame, feature_cols: list[str], name: str, horizon: int = 5,
                   price: str = "close", bounds: DataFrame | None = None) -> DataFrame:
    """Latest feature row per ticker -> probability, prediction, confidence = max(p, 1 - p).  With ``bounds`` (the training
    ranges) values beyond them are clipped first and counted in ``features_clipped``: running totals of the newest bar
    leave the range a linear model was fitted on, and would else carry its margin to a probability of 0 or 1."""
    last = latest_rows(features)
    last = last.withColumn("features_clipped", F.lit(0)) if bounds is None else within_bounds(last, bounds)
    s = score(model, last)
    return s.select("ticker", F.col("date").alias("prediction_date"), (F.col("pred") == 1).alias("prediction"),
                    F.col("prob").alias("outperform_probability"),
                    F.greatest(F.col("prob"), 1 - F.col("prob")).alias("confidence"), F.lit(name).alias("model_name"),
                    F.lit(len(feature_cols)).alias("features_used"), F.col(price).alias("last_price"),
                    F.lit(horizon).alias("prediction_horizon_days"), "features_clipped")
