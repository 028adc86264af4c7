"""The test tables seen as collected news: the same expressions in Spark and, as a common table expression, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a scan, dealt by ``key`` over all cores where its files have fewer splits than there are cores, as small ones do. Larger tables are read as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    published = F.expr("timestamp'2026-09-20 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(7 * doc_id as int), 0)").cast("timestamp_ntz")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.trim(F.regexp_extract("text", "^[^.\n]*", 0)).alias("title"), F.col("text").alias("raw_content"), F.col("source").alias("source_name"),
        F.when(F.col("lang") == "en", "rss").otherwise("hackernews").alias("source_type"), published.alias("published_at"), T.content_hash(F.col("text")).alias("content_hash"),
    )
    return rows.withColumn("collection_date", F.to_date(F.col("published_at") + F.expr("interval 330 minutes")))


NEWS = r"""news AS (
  SELECT doc_id AS id, trim(regexp_extract(text, '^[^.\n]*', 0)) AS title, text AS raw_content, source AS source_name,
    CASE WHEN lang = 'en' THEN 'rss' ELSE 'hackernews' END AS source_type,
    TIMESTAMP '2026-09-20 00:00:00' + to_minutes(CAST(7 * doc_id AS BIGINT)) AS published_at,
    sha256(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS content_hash,
    CAST(TIMESTAMP '2026-09-20 00:00:00' + to_minutes(CAST(7 * doc_id + 330 AS BIGINT)) AS DATE) AS collection_date
  FROM documents)"""
