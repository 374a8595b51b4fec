"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.session import scratch_path

#: A word of the contracts: a run of anything but ASCII white space (Java, RE2 and Python read it alike).
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: cuts the lineage, so a
    lost executor costs a reread, not a recomputation, and several consumers share one computation."""
    path = scratch_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of a ``staged`` frame whose last reader has written its own."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, mod: int):
    """crc32 of the id's decimal text, modulo ``mod`` (a fixed train / held-out split)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64, element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) per node on an edge, root the
    smallest node reachable.  Every round takes the least label among the neighbours, hooks each label's own node to
    the least label that any of its members saw, and jumps to the label's label, so that whole regions merge at once
    and the rounds grow with the logarithm of a chain, not with its length.  It runs until no label moves: labels
    only fall, and equal labels across every edge are the components."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    sym = staged(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    last = staged(sym.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), f"{name}-0")
    lab = last
    for i in itertools.count(1):
        near = (sym.join(lab.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v")
                .groupBy("u").agg(F.min("nl").alias("nl")))
        seen = lab.join(near, "u").select("u", "l", F.least("l", "nl").alias("m"))
        own = F.struct("u", "l", "m")
        hook = F.struct(F.col("l").alias("u"), F.lit(None).cast("long").alias("l"), F.col("m"))
        step = seen.select(F.inline(F.array(own, hook))).groupBy("u").agg(F.max("l").alias("l"), F.min("m").alias("m"))
        up = step.select(F.col("u").alias("m"), F.col("m").alias("ml"))
        nxt = staged(step.join(up, "m", "left").select("u", F.least("m", "ml").alias("l"),
                                                        (F.least("m", "ml") < F.col("l")).alias("moved")), f"{name}-{i}")
        discard(last)
        last, lab = nxt, nxt.select("u", "l")
        if nxt.where("moved").isEmpty():
            discard(sym)
            return lab.select(F.col("u").alias("node"), F.col("l").alias("root"))
