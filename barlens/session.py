"""Session construction and cluster-shared scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every barlens job relies on.  ANSI stays on (division uses try_divide everywhere).
# Broadcasts stay behind Spark's size check: a side is broadcast only when its estimated or (with AQE)
# measured size is below the threshold; beyond it the join stays a sort-merge join.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when its frame does
    # no call site per column expression: wide projections are built several times as fast
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "barlens") -> SparkSession:
    """The running session as it was configured, else a new one with the base settings.

    A running session is returned untouched: whoever submitted it chose its settings.  On a new one
    ``shuffle_partitions`` applies only when given; it is meant for local runs.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        b = SparkSession.builder.appName(app)
        if master:
            b = b.master(master)
        for k, v in BASE_CONF.items():
            b = b.config(k, v)
        if shuffle_partitions:
            b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        if master and master.startswith("local"):
            b = b.config("spark.driver.memory", os.environ.get("BARLENS_DRIVER_MEMORY", "16g"))
        spark = b.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Unset on a ``local`` master (tests), a scratch folder of this machine serves; unset on a cluster is
    an error, since executors could not see a folder of the driver's machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset: name a folder shared by all executors (master {master})")
        d = tempfile.mkdtemp(prefix="barlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A location under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])
