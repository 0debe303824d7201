"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents for the rows it keeps; the last one
returns doc_id, the ids and their digests. `run` writes each stage's result to the shared folder as Parquet and reads it again as the
next one's docs. Null texts count as empty and fail the quality rules; empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, decontamination, near_dedup, quality_rules, secret_scan
from quern.llm.base import table, tidy, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_filter(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows where a text changed."""
    marked = secret_scan.redacted(docs)
    return marked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else marked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids (little-endian unsigned 32-bit integers), n_tokens, ids_sha256."""
    kept = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    coded = byte_bpe.encode_column(docs.select(*kept, "text"))
    return coded.select(*kept, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("secret_scan", redact), ("byte_bpe", encode)]
#: Rolling hashes, near-dedup components and BPE merges are not for SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            tidy(spark)
    return docs
