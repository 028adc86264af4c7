"""Order-dependent operators over rows and over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offset(rows: DataFrame, by: str, order: str, duration: str, lead_in: float = 8.1, gap: float = 0.6) -> DataFrame:
    """When each item starts: the lead-in, all durations before it, and a gap for each of those. Without a duration an item takes no time and no gap."""
    counts = F.coalesce(F.col(duration) > 0, F.lit(False))
    taken = F.when(counts, F.col(duration) + gap).otherwise(F.lit(0.0))
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("starts_at", F.when(counts, lead_in + F.coalesce(F.sum(taken).over(before), F.lit(0.0))))


def islands(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of equal values: (by, island, value, first, last, n)."""
    w = Window.partitionBy(by).orderBy(order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("__s", starts).withColumn("island", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "island").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")


def cues(segments: Column) -> Column:
    """Segments (text, start, end) in order: each starts where the one before ended at the earliest; what has no time left goes."""
    kind = "array<struct<text:string,start:double,end:double>>"
    zero = F.struct(F.lit(0.0).cast("double").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, s):
        start = F.greatest(s["start"], acc["at"])
        fits = start < s["end"]
        cue = F.struct(s["text"].alias("text"), start.alias("start"), s["end"].alias("end"))
        return F.struct(F.when(fits, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fits, F.concat(acc["out"], F.array(cue))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(segments, zero, step, lambda acc: acc["out"])


def hold_parts(duration: Column, cap: float) -> Column:
    """Equal parts of a duration, none above the cap, as (nth, start, end)."""
    n = F.greatest(F.lit(1), F.ceil(duration / cap)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("nth"), (duration * i / n).alias("start"), (duration * (i + 1) / n).alias("end")))


def stride_sample(rows: DataFrame, order: str, n: int, by: str | None = None) -> DataFrame:
    """``n`` rows at equal steps through the order. Ranks come from counts of ranges, so no one task holds all rows."""
    total = rows.count()
    if total <= n:
        return rows
    ranked = ranks(rows, order)
    step = total / n
    wanted = rows.sparkSession.range(n).select(F.floor(F.col("id") * step).cast("long").alias("__rank"))
    return ranked.join(wanted, "__rank", "left_semi").drop("__rank")


def ranks(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``__rank`` from 0 over the whole order: sorted by ranges, numbered inside each, shifted by the counts before it."""
    spread = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    inside = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__skip", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return inside.join(before, "__part").withColumn("__rank", F.col("__n") + F.col("__skip") - 1).drop("__part", "__n", "__skip")
