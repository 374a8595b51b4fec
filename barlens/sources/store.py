"""Persisted bars, processed feature/label sets, and their version listing (parquet)."""

from __future__ import annotations

import datetime as _dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.session import scratch_path

MANIFEST = "prefix string, kind string, version string"


def write_bars(bars: DataFrame, path: str) -> str:
    """Partition by ticker; dynamic partition overwrite replaces only the tickers being written."""
    spark = bars.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        bars.write.mode("overwrite").partitionBy("ticker").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)
    return path


def read_bars(spark: SparkSession, path: str, tickers: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Partition pruning on ticker, predicate pushdown on date."""
    df = spark.read.parquet(path)
    if tickers:
        df = df.filter(F.col("ticker").isin(tickers))
    if start:
        df = df.filter(F.col("date") >= F.lit(_dt.date.fromisoformat(str(start))))
    if end:
        df = df.filter(F.col("date") <= F.lit(_dt.date.fromisoformat(str(end))))
    return df


def write_processed(features: DataFrame, labels: DataFrame, root: str, prefix: str = "processed_data",
                    version: str | None = None) -> str:
    """``<root>/<prefix>_features/version=<v>`` and ``<root>/<prefix>_labels/version=<v>``."""
    v = version or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    write_set(features, root, prefix, "features", v)
    write_set(labels, root, prefix, "labels", v)
    return v


def write_set(df: DataFrame, root: str, prefix: str, kind: str, version: str) -> None:
    """One saved set, and its row in the manifest once the set is complete."""
    df.write.mode("overwrite").parquet(f"{root}/{prefix}_{kind}/version={version}")
    row = df.sparkSession.createDataFrame([(prefix, kind, version)], MANIFEST)
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{prefix}_{kind}_{version}")


def read_processed(spark: SparkSession, root: str, prefix: str = "processed_data", version: str | None = None):
    """Features and labels of one version (latest when not given)."""
    if version is None:
        version = latest_version(spark, root, prefix).select("version").first()[0]
    f = spark.read.parquet(f"{root}/{prefix}_features/version={version}")
    lab = spark.read.parquet(f"{root}/{prefix}_labels/version={version}")
    return f, lab


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """Every saved set (prefix, kind, version), from the manifest: one small row per set, no data file is read."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/*").distinct()


def latest_version(spark: SparkSession, root: str, prefix: str | None = None) -> DataFrame:
    """Versions with both a features and a labels set, newest first (optionally for one prefix)."""
    v = list_versions(spark, root)
    if prefix:
        v = v.filter(F.col("prefix") == prefix)
    f = v.filter("kind = 'features'").select("prefix", "version")
    lab = v.filter("kind = 'labels'").select("prefix", "version")
    return f.join(lab, ["prefix", "version"]).orderBy(F.col("version").desc(), "prefix")


def fresh_files(spark: SparkSession, path: str, ttl_days: float = 1.0, now: _dt.datetime | None = None) -> DataFrame:
    """Rows from files modified within the TTL before ``now`` (default: when the newest file was written);
    older cached files are ignored."""
    df = spark.read.parquet(path)
    written = F.col("_metadata.file_modification_time")
    at = F.lit(now) if now is not None else df.select(F.max(written)).scalar()
    return df.filter(written >= at - F.make_dt_interval(secs=F.lit(ttl_days * 86400.0)))


def default_root(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "store", name)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A hash of the names, sizes and modification times of the files under ``paths`` (a listing, no data read)."""
    seen = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]
