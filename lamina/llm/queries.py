"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontamination, digest_index, divergence, fingerprints, licenses, ngram_join, periodic, rollups, sharding, suffix_dedup, tokens, toxicity, urls
from lamina.llm.common import shared_dir, shuffle_width, table


def tokenizer_path() -> str:
    """The public vocabulary file; other files can be given to the operator itself."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), threshold=(90, 100), words=3).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, delete those of quality 0, revise those in de to the next tokenizer version; the second batch is committed twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    roll = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    roll.commit("b1-insert", rollups.inserts(docs, "spaced-1"))
    counted = docs.select("doc_id", "lang", "source", rollups.counts(F.col("text"), "spaced-1").alias("n"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))
    gone = counted.join(bad, "doc_id", "left_semi").select("source", "lang", F.lit("spaced-1").alias("tokenizer"), F.lit(-1).cast("long").alias("n_docs"), (-F.col("n")).alias("n_tokens"), (-F.col("b")).alias("n_bytes"))
    for _ in range(2):
        roll.commit("b2-delete", gone)
    kept = docs.where("lang = 'de'")
    both = kept.select("doc_id", "source", "lang", *[rollups.counts(F.col("text"), v).alias(k) for k, v in (("n1", "spaced-1"), ("n2", "alnum-2"))], F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b")).join(bad, "doc_id", "left_anti")
    way = lambda v, s, n: F.struct(F.lit(v).alias("tokenizer"), F.lit(s).cast("long").alias("n_docs"), (F.col(n) * s).alias("n_tokens"), (F.col("b") * s).alias("n_bytes"))
    roll.commit("b3-revise", both.select("source", "lang", F.explode(F.array(way("spaced-1", -1, "n1"), way("alnum-2", 1, "n2"))).alias("d")).select("source", "lang", "d.*"))
    return roll.totals()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_periods(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.periodic_runs(docs, exponent=4, least=6))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in two batches, so the second meets an index that knows the first."""
    index = digest_index.DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}", shuffle_width(spark))
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    return digest_index.keep_last(table(spark, sf_dir, "documents"), index, [("b1", half == 0), ("b2", half == 1)])


OP9_SQL = r"""
WITH d AS (
  SELECT source, lang, CASE WHEN lang = 'de' THEN 'alnum-2' ELSE 'spaced-1' END AS tokenizer,
         len(regexp_extract_all(text, CASE WHEN lang = 'de' THEN '[0-9A-Za-z]+' ELSE '[^ \t\n\f\r]+' END)) AS n,
         coalesce(octet_length(encode(text)), 0) AS b
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(b) AS BIGINT) AS n_bytes
FROM d GROUP BY source, lang, tokenizer
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES = {f.__name__: f for f in (op1_sharding, op2_suffix_dedup, op3_license_scan, op4_url_filter, op5_decontamination, op6_fingerprints, op7_ngram_join, op8_toxicity, op9_token_counts, op10_bpe, op11_divergence, op12_periodic_runs, op13_exact_dedup)}
ORACLE_SQL = {"op3_license_scan": licenses.SQL, "op9_token_counts": OP9_SQL, "op11_divergence": divergence.SQL, "op13_exact_dedup": OP13_SQL}
