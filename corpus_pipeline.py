"""From raw documents to shards of a training mix: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from barlens.llm.common import discard, staged, table

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below ``TOXIC_FROM``; the model is fitted on the labelled documents.  Rows with a null or
    empty text have the score of an empty segment and stay; repeated rows are scored alike."""
    run = toxicity.score_column(toxicity.fit(docs, table(spark, sf_dir, "labels")), spark)
    return docs.where(run(F.col("text").cast("string"))["score"] < TOXIC_FROM)


def _packed(docs: DataFrame, **keys) -> DataFrame:
    """Each row whole in ``row``, so that a stage's own columns clash with none of its, beside ``keys``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns(keys)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id (then any) of each near-duplicate group (five-word shingles, similarity 0.8).  Every row is
    a document of its own, whatever its id.  Rows without words stay, but for repeats of one id and text."""
    rows = staged(_packed(docs, key=F.monotonically_increasing_id()), "copies-rows")
    found = near_dedup.near_duplicates(rows.select("key", F.col("row.text").alias("text")), shingle=5, num=80, den=100, id_col="key")
    found = found.select(F.col("doc_id").alias("key"), "component_id", "n_shingles")
    ids = rows.select("key", F.col("row.doc_id").alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("hash"))
    repeat = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    group = (F.when(~repeat, F.col("component_id")).alias("in_group"), F.when(repeat, F.col("id")).alias("same_id"), F.when(repeat, F.col("hash")).alias("same_text"))
    keep = ids.join(found, "key").groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")).select("least.key")
    return rows.join(keep, "key", "leftsemi").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _same(doc_id, text_hash):
    """One string for rows of equal id and text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), text_hash.cast("string"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it (weights 3, 1, 2 over the sources, 150 % of all words).  Rows of equal id
    and text are taken as one, as often as all of them; rows without words take nothing and go."""
    plan = mixing.mix(docs).where("copies > 0").select(_same(F.col("doc_id"), F.col("text_hash")).alias("same"), "copies")
    plan = plan.groupBy("same").agg(F.sum("copies").cast("int").alias("copies"))
    rows = _packed(docs, same=_same(F.col("row.doc_id"), F.xxhash64(F.col("row.text").cast("string")))).dropDuplicates(["same"])
    return rows.join(plan, "same").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the final shards: id, size, checksum, shard and slot of every record, null and repeated ones too."""
    return sharding.shard(docs, shards=40).drop("grown_shard", "text_hash")


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_copies), ("decontamination", drop_leaks),
          ("mixing", mix_sources), ("sharding", to_shards)]

#: the toxicity model and the MinHash groups are not SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
