"""The operators' queries over the driver's tables, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, license_scan, secret_scan, toxicity, url_rules
from tidemark.llm.jaccard_join import jaccard_join
from tidemark.llm.language_id import identify
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.oracles import oracle_sql  # noqa: F401
from tidemark.llm.source_audit import audit
from tidemark.llm.token_alignment import token_alignment
from tidemark.llm.token_counts import token_counts
from tidemark.llm.vector_search import nearest
from tidemark.session import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_grades(labels: DataFrame) -> DataFrame:
    """Ordered severity: 0 not toxic, 1 toxic, 2 toxic and of low quality; without a toxic label none."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, toxicity_grades(table(spark, sf_dir, "labels"))))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("same")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("removed").alias("chunks_removed"), F.length("text").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("value_sha256", F.sha2(F.col("value").cast("binary"), 256)).drop("value")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_url_rules, op3_ngram_jaccard_join, op4_license_scan, op5_decontamination, op6_bpe, op7_line_dedup, op8_secret_scan, op9_language_id, op10_vector_search, op11_token_counts, op12_source_audit, op13_token_alignment, pipeline)}
