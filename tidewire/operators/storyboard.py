"""Segments, scenes, captions and checks: the parts of video planning that are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a segment a comparison, statistic, quotation or concept.
COMPARISON = r"(?i)\b(compared (to|with)|versus|vs\.?|more than|less than|higher than|lower than|up from|down from|from \S+ to)\b"
STATISTIC = r"(?i)\$\s?\d|\b\d[\d,.]*\s?(%|percent|million|billion|trillion|x)|\b\d{1,3}(,\d{3})+\b"
QUOTATION = "[\"“][^\"”]{8,}[\"”]"
CONCEPT = r"(?i)\b(because|which means|in other words|called|known as|designed to|works by)\b"


def segment_type(text: Column, companies: Column, products: Column) -> Column:
    """The first kind that fits, in fixed order."""
    low = F.lower(text)
    held = lambda names: F.exists(names, lambda n: F.contains(low, n))
    return F.when(text.rlike(COMPARISON), "comparison").when(text.rlike(STATISTIC), "statistic").when(text.rlike(QUOTATION), "quote").when(held(companies), "company").when(held(products), "product").when(text.rlike(CONCEPT), "concept").otherwise("key_fact")


def scenes(segments: DataFrame, by: str, order: str) -> DataFrame:
    """(by, scene, kind, start, end, text) from segments (by, order, text, kind, start, end): the first is the hero, runs of heroes merge, each scene starts where the one before ended."""
    w = Window.partitionBy(by).orderBy(order)
    kinds = segments.withColumn("kind", F.when(F.row_number().over(w) == 1, "hero").otherwise(F.col("kind")))
    new = F.when((F.col("kind") == "hero") & (F.lag("kind").over(w) == "hero"), 0).otherwise(1)
    marked = kinds.withColumn("__n", new).withColumn("scene", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy(by, "scene").agg(F.min_by("kind", order).alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))
    follow = F.lag("end").over(Window.partitionBy(by).orderBy("scene"))
    return parts.withColumn("start", F.coalesce(follow, F.lit(0.0)))


def breaks(rows: DataFrame, by: str, order: str, tolerance: float = 0.01) -> DataFrame:
    """Scenes that do not start where the one before ended."""
    gap = F.abs(F.col("start") - F.lag("end").over(Window.partitionBy(by).orderBy(order)))
    return rows.withColumn("gap", gap).filter(F.col("gap") > tolerance)


def checks(rows: DataFrame, key: list[str], named: dict[str, Column]) -> DataFrame:
    """A row for each check: passed is null where a check does not apply, which fails nothing."""
    each = F.array(*(F.struct(F.lit(n).alias("check_name"), c.alias("passed")) for n, c in named.items()))
    return rows.select(*key, F.explode(each).alias("c")).select(*key, "c.*")


def stage_report(one: DataFrame, total: str, stages: list[str]) -> DataFrame:
    status = lambda c: F.when(F.col(c) == 0, "pending").when(F.col(c) < F.col(total), "running").otherwise("complete")
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("done"), status(s).alias("status")) for s in stages))).alias("x")).select("x.*")


def clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.round(seconds * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def subtitles(segments: Column) -> Column:
    """Numbered caption blocks of segments (text, start, end), as the text of a file."""
    block = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), clock(s["start"]), F.lit(" --> "), clock(s["end"]), F.lit("\n"), s["text"], F.lit("\n"))
    return F.array_join(F.transform(segments, block), "\n")


# Cues closer than JOIN seconds swap without a fade, which else takes FADE milliseconds.
JOIN, FADE = 0.15, 80


def styled_clock(seconds: Column) -> Column:
    """H:MM:SS.cc; times before 0 are 0."""
    t = F.greatest(F.lit(0.0), seconds)
    return F.format_string("%d:%02d:%05.2f", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)


def styled_events(cues: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, event) of cues (by, order, lines, start, end, style): dialogue events that never overlap. A cue starts when the ones before have ended and is left out if nothing remains of it; it fades only where no other follows or precedes within ``JOIN``."""
    w = Window.partitionBy(by).orderBy(order)
    ended = F.max(F.when(F.col("end") > F.col("start"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    timed = cues.withColumn("__p", ended).withColumn("__next", F.lead("start").over(w)).withColumn("__s", F.greatest("start", "__p")).filter(F.col("__s") < F.col("end"))
    fade = lambda near: F.when(near, 0).otherwise(FADE).cast("string")
    fades = F.concat(F.lit("{\\fad("), fade(F.col("__s") - F.col("__p") < JOIN), F.lit(","), fade(F.col("__next") - F.col("end") < JOIN), F.lit(")}"))
    head = F.concat(F.lit("Dialogue: 1,"), styled_clock(F.col("__s")), F.lit(","), styled_clock(F.col("end")), F.lit(","), F.col("style"), F.lit(",,0,0,0,,"))
    return timed.select(by, order, F.concat(head, fades, F.array_join("lines", "\\N")).alias("event"))


def qa_stale(produced: Column, checked: Column, changed: Column) -> Column:
    """Whether checks no longer speak of what is there: produced, but never checked, or produced or changed after the check."""
    later = lambda c: F.coalesce(c > checked, F.lit(False))
    return produced.isNotNull() & (checked.isNull() | later(produced) | later(changed))


def artefact_valid(written: Column, changed: Column) -> Column:
    """Whether a file is there and not older than its content."""
    return written.isNotNull() & F.coalesce(written >= changed, F.lit(True))


# Labels of a post's date and time.
DATE_LABEL, TIME_LABEL = r"^\d{2}/\d{2}/\d{4}$", r"^(1[0-2]|[1-9]):[0-5]\d (AM|PM)$"


def valid_labels(date: Column, time: Column) -> Column:
    return F.coalesce(date.rlike(DATE_LABEL) & time.rlike(TIME_LABEL), F.lit(False))
