"""The queries of this subpackage: ``QUERIES[name](spark, sf_dir)`` and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm import alignment, ann, decontaminate, html_text, langid, mixing, near_dedup, packing, secrets, sharding, token_rollup, toxicity, variants
from barlens.llm.common import fold, table
from barlens.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
                      secrets.digest(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_entropy"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 4) != 2))
    got = toxicity.toxicity(docs, model)
    return got.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40).drop("text_hash")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return got.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_token_rollup(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals after four batches: all documents come in, texts with white space around them are revised to their trimmed
    counts, the first batch arrives again (and changes nothing), and exact copies go (all but the smallest id of a text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    store = token_rollup.Rollup(spark, scratch_path(spark, "llm", f"rollup-{uuid.uuid4().hex}"))
    version = vocabulary.rsplit("/", 1)[-1].split(".")[0]
    counted = lambda d: (token_rollup.with_tokens(d, vocabulary)
                         .select(F.lit("upsert").alias("op"), "doc_id", F.xxhash64("text").alias("text_hash"), "source", "lang", F.lit(version).alias("version"), "tokens"))
    store.commit("0001-load", counted(docs))
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    store.commit("0002-trim", counted(docs.where((F.col("text") != trimmed) & F.col("doc_id").isNotNull()).withColumn("text", trimmed)))
    store.commit("0001-load", counted(docs))
    same = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    first = same.groupBy("h", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    copies = same.join(first, ["h", "n"]).where("doc_id <> first").select(F.lit("delete").alias("op"), "doc_id", F.col("h").alias("text_hash"), *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("version", "string"), ("tokens", "long"))])
    store.commit("0003-copies", copies)
    return store.totals()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                                               F.col("lang").alias("lang_pred"), "score", "accepted")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, byte_file: str = BYTE_BPE, piece_file: str = PIECE_BPE) -> DataFrame:
    got = alignment.align_corpus(table(spark, sf_dir, "documents"), byte_file, piece_file)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.words(table(spark, sf_dir, "documents"), least=7, at_least=2, thin=31), ratio=10)


def op13_packing(spark: SparkSession, sf_dir: str, tokenizer: str = BYTE_BPE) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), tokenizer, capacity=2048, end_id=1)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_ann, op2_minhash_dedup, op3_secrets, op4_toxicity, op5_sharding, op6_mixing,
                                   op7_token_rollup, op8_decontamination, op9_html_text, op10_langid, op11_tokenizer_alignment,
                                   op12_spelling_variants, op13_packing)}

ORACLE = {
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
k AS (SELECT *, cap * lft <= w * (total - gone) AS capped FROM c),
l AS (SELECT (total - gone) / lft AS level FROM k WHERE NOT capped ORDER BY gone LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped OR (SELECT level FROM l) IS NULL THEN cap ELSE w * (SELECT level FROM l) END AS target FROM k),
p AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (epochs + CASE WHEN size > 0 AND 2.0 * before + size <= 2.0 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken,
       source
FROM p""",
    # CRC-32 by its table; words one edit apart share a word with one code point left out
    "op12_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM runs GROUP BY ALL),
raw AS (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM low),
sums AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                               lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM raw, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM sums),
v AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS o FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word FROM cut a JOIN v b ON a.rest = b.word
         UNION SELECT b.word, a.word FROM cut a JOIN v b ON a.rest = b.word),
found AS (SELECT near.word, count(*)::BIGINT AS n_near, min({'m': -o.n, 'w': near.o}) AS best FROM near JOIN v o ON o.word = near.o GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * v.n THEN best.w END AS form, CASE WHEN -best.m >= 10 * v.n THEN -best.m END AS form_n
      FROM v LEFT JOIN found USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at AND f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain c USING (word) JOIN f e ON e.word = c.at AND e.form IS NULL""",
}
