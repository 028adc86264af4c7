"""Labels that are read, and reports that are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "id long, tech string, ai string, ctype string, aud string, exp string, conf string, tags string, note string"


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows of a file with a header; the list of tags becomes a set, empty where there is none."""
    rows = spark.read.csv(path, header=True, schema=LABEL, multiLine=True, escape='"')
    return rows.withColumn("tags", F.array_distinct(F.array_remove(F.split(F.coalesce("tags", F.lit("")), ","), "")))


def labelled(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items (id, title, summary) with their labels and the text they are judged by. Items without a label are left out."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))
    return items.join(labels, "id").withColumn("text", text)


def artefacts(scenes: DataFrame, by: str, order: str) -> DataFrame:
    """(by, json): one document a story, its scenes in order."""
    columns = [c for c in scenes.columns if c not in (by, order)]
    kept = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return scenes.groupBy(by).agg(kept.alias("scenes")).select(by, F.to_json(F.struct(by, "scenes")).alias("json"))


def markdown(rows: DataFrame) -> DataFrame:
    """(value): the lines of a table, in the order of all columns. A report is a summary, so its lines are sorted in one file."""
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select(F.lit(2).alias("__n"), F.struct(*rows.columns).alias("__k"), bar([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("value"))
    heads = rows.sparkSession.range(2).select((F.col("id") + 0).cast("int").alias("__n"), F.lit(None).cast(body.schema["__k"].dataType).alias("__k"), F.when(F.col("id") == 0, bar([F.lit(c) for c in rows.columns])).otherwise(bar([F.lit("-") for _ in rows.columns])).alias("value"))
    return heads.unionByName(body).coalesce(1).sortWithinPartitions("__n", "__k").select("value")


def write_report(rows: DataFrame, path: str) -> None:
    """A summary as JSON lines and as a table to read, side by side under ``path``."""
    rows.write.mode("overwrite").json(f"{path}/json")
    markdown(rows).write.mode("overwrite").text(f"{path}/markdown")
