"""Token counts as delta-maintained rollups.

Every committed batch of changes leaves two small tables in the store: ``deltas``, the signed totals by source,
language and tokenizer version, and ``ledger``, the signed entries of its documents by buckets of their key, from which
a later delete or revision takes the counts it has to withdraw.  Totals are sums over the deltas of committed batches, so they are
additive and no document is counted again.  A batch is committed by the marker file that Spark's writer leaves last:
a batch that was interrupted is written again, one that was committed is skipped, so commits are idempotent.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the split pattern that belongs to the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "version"]
_LEDGER = "key string, doc_id long, source string, lang string, version string, tokens long, rows long, bucket int"
_BUCKETS = 64


@lru_cache(maxsize=4)
def _encoding(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens``: the number of tokens of the whole text (null: 0).  ``vocabulary`` is the path of a
    rank file on the driver; executors get its content."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        enc = _encoding(shared.value)
        return pd.Series([sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in text], dtype="int64")

    return docs.withColumn("tokens", count(F.col(text_col).cast("string")))


def _pieces(text: str, size: int = 200_000) -> Iterator[str]:
    """The text cut before spaces that follow a letter, where the split pattern cuts as well: bounds the encoder's
    work on very long texts without changing any token."""
    at = 0
    while at < len(text):
        to = at + size
        while to < len(text) and not (text[to] == " " and text[to - 1].isalpha()):
            to += 1
        yield text[at:to]
        at = to


@dataclass(frozen=True)
class Rollup:
    """A store of deltas and ledger entries under ``path`` (a folder that all executors share)."""

    spark: SparkSession
    path: str

    def _folder(self, kind: str, batch: str) -> str:
        return f"{self.path}/{kind}/{batch}" if kind == "deltas" else f"{self.path}/{kind}/batch={batch}"

    def _has(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> list[str]:
        """Names of the committed batches, in order."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if self._has(f"{self.path}/deltas/{n}/_SUCCESS"))

    def _entries(self, buckets: list[int] | None = None) -> DataFrame:
        parts = [self._folder("ledger", b) for b in self.batches()]
        rows = self.spark.read.option("basePath", f"{self.path}/ledger").schema(_LEDGER).parquet(*parts) if parts else self.spark.createDataFrame([], _LEDGER)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """What is counted now: ``key, doc_id, source, lang, version, tokens, rows`` (equal rows as one, with their number)."""
        got = self._entries(buckets).groupBy("key", "doc_id", *KEYS, "tokens").agg(F.sum("rows").alias("rows"))
        return got.where("rows > 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, text_hash, source, lang, version, tokens) as the batch of that name; False when
        it was committed before.  ``op``: ``upsert`` rows of a document, all of them, are its new state: what was counted
        of it before is withdrawn; ``delete`` withdraws it.  A document is all rows of an id, so rows that repeat an id
        all count; rows without an id are documents by their text hash.  Deletes of unknown documents change nothing;
        a document with both kinds of change in a batch is upserted.  Of the ledger only the buckets that the changes
        fall into are read."""
        if self._has(f"{self._folder('deltas', batch)}/_SUCCESS"):
            return False
        own = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("h"), F.coalesce(F.col("text_hash").cast("string"), F.lit(""))))
        rows = changes.select((F.col("op") == "upsert").alias("up"), own.alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                              *[F.col(c).cast("string").alias(c) for c in KEYS], F.coalesce(F.col("tokens").cast("long"), F.lit(0)).cast("long").alias("tokens"))
        # equal rows are counted before anything else: copies without an id, however many, are one row
        rows = rows.groupBy("up", "key", "doc_id", *KEYS, "tokens").agg(F.count("*").alias("rows")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(_BUCKETS)).cast("int"))
        new = rows.where("up").drop("up")
        if self.batches():
            touched = rows.select("key", "bucket").distinct()
            buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most _BUCKETS
            old = self.ledger(buckets).join(touched, "key").withColumn("rows", -F.col("rows"))
            new = new.unionByName(old)
        new.write.mode("overwrite").partitionBy("bucket").parquet(self._folder("ledger", batch))
        entries = self.spark.read.option("basePath", f"{self.path}/ledger").schema(_LEDGER).parquet(self._folder("ledger", batch))
        part = lambda keep, value: F.sum(F.when(keep, value).otherwise(0)).cast("long")
        n, t = F.col("rows"), F.col("rows") * F.col("tokens")
        deltas = entries.groupBy(*KEYS).agg(part(n > 0, n).alias("docs_in"), part(n > 0, t).alias("tokens_in"), part(n < 0, -n).alias("docs_out"), part(n < 0, -t).alias("tokens_out"))
        deltas.write.mode("overwrite").parquet(self._folder("deltas", batch))
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` now, with the gross sums in and out."""
        schema = "source string, lang string, version string, docs_in long, tokens_in long, docs_out long, tokens_out long"
        parts = [self._folder("deltas", b) for b in self.batches()]
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("docs_in", "tokens_in", "docs_out", "tokens_out")])
        return sums.select(*KEYS, (F.col("docs_in") - F.col("docs_out")).alias("docs"), (F.col("tokens_in") - F.col("tokens_out")).alias("tokens"),
                           "docs_in", "tokens_in", "docs_out", "tokens_out")
