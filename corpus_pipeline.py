"""The corpus pipeline: classify, deduplicate, redact, mix, pack. Each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import mixing, neardup, packing, pii, quality
from tidewire.llm.common import Tables, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts get the intercept's score and are judged by it; rows that repeat are judged alike."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; of rows that repeat an id and its text, one.

    Rows that share an id but not their text are judged each by its own text. Rows without doc_id stay, as do texts without words.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))
    kept = neardup.near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__h", text_hash).join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__hash")))
    rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("text"))).filter("__row = 1").drop("__row", "__id", "__hash", "__h")
    return rows.unionByName(docs.filter("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, in every row. Null and empty texts stay as they are."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them. Texts without words are not among them; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences; rows that repeat an id are packed each. Empty table: no rows, here as in each stage."""
    return packing.pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Not expressible in SQL: it trains models and tokenises.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's input goes once its output is written."""
    tables, docs = Tables(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, tables.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
