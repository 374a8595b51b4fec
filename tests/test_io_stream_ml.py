"""Persistence, streaming and MLlib paths (the rows-only queries) on small inputs."""

import os

import pytest
from conftest import closes, make_bars
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_bar_store_dynamic_overwrite_and_pruning(spark, tmp_path):
    from barlens.sources import store

    a = make_bars(spark, closes(spark, "A", [1, 2, 3]) + closes(spark, "B", [4, 5]))
    path = str(tmp_path / "bars")
    store.write_bars(a, path)
    store.write_bars(make_bars(spark, closes(spark, "B", [9])), path)  # replaces only B
    got = {(r.ticker, r.close) for r in store.read_bars(spark, path).collect()}
    assert got == {("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 9.0)}
    assert store.read_bars(spark, path, tickers=["A"]).count() == 3


def test_processed_versions_pair_and_order(spark, tmp_path):
    from barlens.sources import store

    root = str(tmp_path)
    df = make_bars(spark, closes(spark, "A", [1, 2]))
    store.write_processed(df, df.select("ticker", "date"), root, prefix="training", version="20240101_000000")
    store.write_processed(df, df.select("ticker", "date"), root, prefix="training", version="20240301_000000")
    df.write.parquet(f"{root}/orphan_features/version=20240401_000000")
    v = [(r.prefix, r.version) for r in store.latest_version(spark, root).collect()]
    assert v == [("training", "20240301_000000"), ("training", "20240101_000000")]
    f, lab = store.read_processed(spark, root, prefix="training")
    assert f.count() == 2 and lab.count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_stream_bars_equal_batch_bars(spark):
    from barlens.sources.bars import event_bars
    from barlens.streaming.bars import stream_bars

    s = stream_bars(spark, SF)
    b = event_bars(spark, SF).select(*s.columns)
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == b.exceptAll(s).count() == 0
    assert stream_bars(spark, SF).exceptAll(s).count() == 0  # a second run goes on from the first


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_stream_dedup_is_idempotent(spark):
    from barlens.streaming.bars import stream_dedup

    d = stream_dedup(spark, SF)
    assert d.count() == d.select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_fresh_files_by_reference_time(spark, tmp_path):
    import datetime as dt

    from barlens.sources import store

    path = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(path)
    old = dt.datetime(2020, 1, 1).timestamp()
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            os.utime(f"{path}/{f}", (old, old))
    spark.range(2).coalesce(1).write.mode("append").parquet(path)
    assert store.fresh_files(spark, path).count() == 2  # the old file is past its time to live
    assert store.fresh_files(spark, path, ttl_days=36500).count() == 5
    assert store.fresh_files(spark, path, now=dt.datetime(2100, 1, 1)).count() == 0


def test_histogram_keeps_empty_bins(spark):
    from barlens.operators import reports

    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 10.0), ("b", 5.0), ("c", None)], "ticker string, v double")
    got = {(r.ticker, r.bin): r["count"] for r in reports.histogram(df, "v", 5, "ticker").collect()}
    assert got == {("a", 0): 1, ("a", 1): 0, ("a", 2): 0, ("a", 3): 0, ("a", 4): 2, **{("b", i): int(i == 0) for i in range(5)}}
    assert [r["count"] for r in reports.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 3]
    assert reports.histogram(df.where("v is null"), "v", 2).count() == 0


def test_prefix_sums_split_every_key(spark):
    from barlens.operators import metrics

    rows = [(f"f{k}", float(i) * 10.0 ** (k % 7), 1) for k in range(20) for i in range(50)]  # columns on different scales
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = metrics.prefix_sums(df, "v", ["n"], ["k"], buckets=60)
    want = {(k, v): i + 1 for k in {r[0] for r in rows} for i, v in enumerate(sorted(r[1] for r in rows if r[0] == k))}
    assert {(r.k, r.v): r.cum_n for r in got.collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_newest_rows_as_of_a_date(spark):
    from barlens.plans.pipeline_queries import newest_rows
    from barlens.sources.bars import bars

    last = {r.ticker: r.d for r in bars(spark, SF).groupBy("ticker").agg(F.max("date").alias("d")).collect()}
    assert {r.ticker: r.date for r in newest_rows(spark, SF).collect()} == last
    before = newest_rows(spark, SF, as_of="1998-06-30").collect()
    assert before and all(str(r.date) <= "1998-06-30" and r.n_rows >= 50 for r in before)
    assert newest_rows(spark, SF, min_rows=10 ** 6).count() == 0


def test_train_all_chooses_on_validation_rows_and_records_failures(spark):
    from barlens.operators import models

    rows = [(float(i % 7) - 3.0, float((i * 5) % 11) - 5.0, int(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, outperforms int")
    out, fitted = models.train_all(df, df, ["x1", "x2"], ["logistic_regression", "no_such_model"], val=df)
    got = {r.model_name: r for r in out.collect()}
    assert set(fitted) == {"logistic_regression"} and got["logistic_regression"].is_best and got["logistic_regression"].val_auc > 0.9
    assert got["no_such_model"].error and not got["no_such_model"].is_best
    out, _ = models.train_all(df, df, ["x1", "x2"], ["no_such_model"], val=df)
    assert out.count() == 1  # no model at all is not an error


def test_logistic_fit_save_load_score(spark, tmp_path):
    from barlens.operators import models

    rows = [(f"T{i % 3}", i, float(i % 7) - 3.0, float((i * 5) % 11) - 5.0, int(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "ticker string, d int, x1 double, x2 double, outperforms int")
    df = df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).withColumn("close", F.lit(1.0))
    m = models.fit("logistic_regression", df, ["x1", "x2"])
    ev = models.evaluate(m, df, "logistic_regression").first()
    assert ev.auc > 0.9
    p = str(tmp_path / "lr.model")
    models.save_model(m, p, str(tmp_path / "registry"), "logistic_regression", None, 2, 120)
    loaded = models.load_model(p)
    assert models.score(loaded, df).filter("pred = outperforms").count() > 100
    assert spark.read.parquet(str(tmp_path / "registry")).count() == 1
    s = models.score_universe(loaded, df, ["x1", "x2"], "logistic_regression")
    assert s.count() == 3 and set(s.columns) >= {"prediction", "confidence", "outperform_probability"}
    imp = models.feature_importance(m, ["x1", "x2"])
    assert imp.count() == 2
