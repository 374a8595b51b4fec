"""Structured Streaming: raw events -> OHLCV bars, and idempotent re-ingest.

The file source reads the ``events`` parquet; event time is cast from ``timestamp_ntz`` to ``timestamp``
(watermarks need the latter).  A stream has one name, and with it one sink and one checkpoint under the shared
checkpoint folder: a run that follows an earlier one, or a lost driver, goes on from the committed offsets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.session import scratch_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, max_files: int = 64) -> DataFrame:
    s = (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
         .option("maxFilesPerTrigger", max_files).parquet(sf_dir))
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def bars_from_events(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Windowed OHLCV per event type; a window is emitted once the watermark passes its end."""
    order = F.struct("ts", "event_id")
    return (events.withWatermark("ts", lateness)
            .groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("ticker"))
            .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                 F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"))
            .select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume"))


def stream_name(kind: str, sf_dir: str) -> str:
    return f"{kind}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers N of the complete folders ``name=N`` under ``path``."""
    p, fs = _fs(spark, path)
    names = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.getName().split("=")[1]) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def run_updates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a windowed aggregate to the end of its input in update mode and return the newest state of each window.

    Every batch writes the windows it changed to a folder of its own number, so a batch that is run again replaces
    itself.  After the run the batches are folded into one state folder and removed: the next run reads that state
    and its own batches only."""
    spark = df.sparkSession
    out = scratch_path(spark, "streams", name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/data/part={number}")

    (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    states, parts = _numbers(spark, f"{out}/state"), _numbers(spark, f"{out}/data")
    upto = states[-1] if states else -1
    new = [n for n in parts if n > upto]
    if new:
        rows = spark.read.parquet(*[f"{out}/data/part={n}" for n in new], *[f"{out}/state/upto={upto}" for _ in states[-1:]])
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))
        rows.withColumn("_n", newest).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{out}/state/upto={new[-1]}")
        upto = new[-1]
    for kind, numbers in (("data/part", parts), ("state/upto", [n for n in states if n < upto])):
        for n in numbers:  # what the new state holds
            p, fs = _fs(spark, f"{out}/{kind}={n}")
            fs.delete(p, True)
    return spark.read.parquet(f"{out}/state/upto={upto}").drop("batch")


def run_distinct(df: DataFrame, name: str, keys: list[str], day: str) -> DataFrame:
    """Run a stream to the end of its input and land every ``keys`` once, however far apart its copies arrive.

    The landed rows are the ledger: a batch drops its own repeats and every key that earlier batches landed on the
    same days (partitions of the sink), then writes a folder of its own number, which a repeated batch replaces."""
    spark = df.sparkSession
    out = scratch_path(spark, "streams", name)

    def land(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.to_date(day)).dropDuplicates(keys)
        earlier = [f"{out}/data/part={n}" for n in _numbers(spark, f"{out}/data") if n < number]
        if earlier:
            ledger = spark.read.option("basePath", f"{out}/data").parquet(*earlier)
            rows = rows.join(ledger.select(*keys, "day"), [*keys, "day"], "leftanti")  # the days of the batch prune the ledger
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{out}/data/part={number}")

    (df.writeStream.foreachBatch(land).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.option("basePath", f"{out}/data").parquet(*[f"{out}/data/part={n}" for n in _numbers(spark, f"{out}/data")]).select(*df.columns)


def run_appends(df: DataFrame, name: str) -> str:
    """Run an append-only plan to the end of its input into a parquet sink; returns its path."""
    out = scratch_path(df.sparkSession, "streams", name, "data")
    (df.writeStream.format("parquet").outputMode("append").option("path", out)
     .option("checkpointLocation", scratch_path(df.sparkSession, "streams", name, "checkpoint")).trigger(availableNow=True).start().awaitTermination())
    return out


def stream_bars(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Bars of all events seen so far, open windows included: the newest state of each window."""
    return run_updates(bars_from_events(event_stream(spark, sf_dir)), name or stream_name("bars", sf_dir), ["ticker", "bar_start"])


def dedup_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Repeats within the watermark dropped by stream state alone (no ledger; later repeats and late rows are lost)."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stream_dedup(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The same range fetched twice (two sources over the same files) lands once, also over several runs."""
    twice = event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir))
    return run_distinct(twice, name or stream_name("dedup", sf_dir), ["event_id"], "ts")
