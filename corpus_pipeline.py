"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
keep the columns of documents, whatever further ones there are; the last returns the
token digests. A null or wordless text has no language and goes in the first stage; a
null doc_id is kept by every stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate
from tidemark.llm.jaccard_join import BROADCAST_IDS, jaccard_join
from tidemark.llm.language_id import UNKNOWN, identify
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.queries import vocabulary_path
from tidemark.session import discard, materialise, table

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text has a language; ``lang`` becomes the predicted one.

    Null texts and those without a letter go; a text of grams that no language has stays,
    under the language that the operator gives it.
    """
    found = identify(docs, keep=docs.columns)
    rest = [c for c in docs.columns if c != "lang"]
    kept = found.where(F.col("lang_pred") != UNKNOWN)
    return kept.select(*rest, F.col("lang_pred").alias("lang")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document that loses all its text goes."""
    cleaned = line_dedup(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = cleaned.where((F.col("removed") == 0) | (F.trim(F.col("text")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id.

    Rows, not ids, are joined: of repeated rows one stays, the texts of one doc_id are
    judged each, and a row without doc_id gives way to one with it. Of rows with the
    same doc_id in a group the one with the smallest text hash stays. Texts without
    words stay.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_join(numbered.select(F.col(row).alias("doc_id"), "text"), links=False).where("n_shingles > 0")
    keys = numbered.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("same"), F.col(row).alias("row")).alias("place"))
    placed = keys.join(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "row")
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    gone = materialise(placed.join(first, "component").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)))
    some = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return numbered.join(some, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.bpe_digests(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: The learned language model, the chunk boundaries and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; what one has read is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
