"""The corpus pipeline: documents go through quality, near-duplicate, benchmark and personal-data stages and are encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
:func:`run` writes each stage's rows as Parquet into the shared checkpoint folder and reads them for the next, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, neardup, pii, quality
from sparkloom.session import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity passes their language's threshold.

    Documents without words (null and empty texts too) and all rows without a trusted language stay; rows that repeat
    stay or go together. An empty table gives none.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest ``doc_id``, null last; of repeated rows one.

    Null and empty texts are one class. An empty table gives none.
    """
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together; an empty table on either side takes nothing out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null texts stay null, repeated rows stay; an empty table gives none."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit), their number, and whether they decode to its text.

    Null texts count as empty, which have no ids; repeated rows stay; extra columns of any name go. An empty table gives none.
    """
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("text"), F.sha2(text, 256).alias("digest"))
    out = bpe.encode_texts(rows, keep=[*keep, "digest"])
    return out.select(*keep, "ids", "n_tokens", (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("byte_bpe", encoding),
]

#: Near duplicates and perplexities are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
