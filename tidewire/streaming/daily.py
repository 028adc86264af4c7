"""Arrivals by business day as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A business day in Indian time starts at 18:30 UTC.
DAY = ("1 day", "1 day", "18 hours 30 minutes")


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under ``path``."""
    schema = spark.read.parquet(path).schema
    base, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{base}/{name[:-1]}[{name[-1]}]" if name else path)


def day_counts(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and values by day and type. An event that comes again is counted once; one later than ``late`` not at all."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", *DAY), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_once(df: DataFrame, checkpoint: str) -> DataFrame:
    """All that is there, then stop; the result as a table of the session."""
    name = f"tidewire_{uuid.uuid4().hex}"
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
