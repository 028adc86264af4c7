"""Checks of episodes and of scenes: (check_name, passed, detail) rows, by one aggregation and one explode. Where a check does not apply ``passed`` is null, which fails nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a finished episode and its scenes have to keep to.
STORIES, MOST_SECONDS, TOLERANCE, WARN = 25, 300.0, 0.01, 0.8
SCENE_SECONDS, CUE_SECONDS, CUE_WORDS = 7.5, 8.0, 20


def _rows(one: DataFrame, key: list[str], checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("check_name"), ok.alias("passed"), detail.cast("string").alias("detail")) for n, (ok, detail) in checks.items()))
    return one.select(*key, F.explode(each).alias("c")).select(*key, "c.*")


def episode_checks(stories: DataFrame, key: str = "episode_id") -> DataFrame:
    """Of episodes' primary stories (key, ai_relevance, verification_status, canonical_url, cues, audio_seconds, script_quality_status, video_seconds)."""
    n = F.count("*")
    few = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    one = stories.groupBy(key).agg(
        n.alias("n"), few(F.col("ai_relevance") == "ai_candidate").alias("other"), few(F.col("verification_status") == "verified").alias("unverified"), few(F.col("canonical_url").rlike("^https?://")).alias("unlinked"),
        few(F.col("cues") > 0).alias("silent"), few(F.col("audio_seconds") > 0).alias("mute"), F.count("script_quality_status").alias("graded"),
        few(F.col("script_quality_status").isin("pass", "edited")).alias("weak"), F.max("video_seconds").alias("seconds"),
    )
    zero = lambda c, said: (F.col(c) == 0, F.concat(F.col(c).cast("string"), F.lit(f" {said}")))
    return _rows(one, [key], {
        "story_count": (F.col("n") == STORIES, F.concat(F.col("n").cast("string"), F.lit(f" of {STORIES}"))), "ai_only": zero("other", "not about AI"), "verification": zero("unverified", "unverified"),
        "source_links": zero("unlinked", "without a link"), "captions": zero("silent", "without captions"), "audio": zero("mute", "without audio"),
        "script_quality": (F.when(F.col("graded") > 0, F.col("weak") == 0), F.concat(F.col("weak").cast("string"), F.lit(" below pass"))), "video": (F.col("seconds").isNotNull(), F.lit("")),
        "duration": (F.when(F.col("seconds").isNotNull(), F.col("seconds") <= MOST_SECONDS), F.round("seconds", 2)),
    })


def scene_checks(scenes: DataFrame, story: str = "story_id") -> DataFrame:
    """Of a story's scenes (story, scene, kind, start, end, text, source_text, audio_seconds, longest_cue, cue_words): structure, contiguity, lengths, repeats, figures that the source has, and caption budgets."""
    w = Window.partitionBy(story).orderBy("scene")
    figures = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    rows = scenes.withColumn("gap", F.abs(F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0.0)))).withColumn("loose", F.size(F.array_except(figures("text"), figures("source_text"))))
    one = rows.groupBy(story).agg(
        F.count("*").alias("n"), F.min_by("kind", "scene").alias("first"), F.max("gap").alias("gap"), F.count_if(F.col("end") <= F.col("start")).alias("empty"), F.max(F.col("end") - F.col("start")).alias("longest"),
        (F.count("text") - F.count_distinct("text")).alias("again"), F.sum("loose").alias("loose"), F.max("end").alias("end"), F.max("audio_seconds").alias("audio"), F.max("longest_cue").alias("cue"), F.max("cue_words").alias("words"),
        F.count_if((F.col("kind") == "statistic") & (F.size(figures("text")) == 0)).alias("bare"), F.count_if(F.col("kind") == "takeaway").alias("ends"), F.max_by("kind", "scene").alias("last"),
    )
    budget = lambda c, most: (F.when(F.col(c).isNotNull(), F.col(c) <= most), F.when(F.col(c) > WARN * most, F.concat(F.lit("near the limit: "), F.col(c).cast("string"))).otherwise(F.lit("")))
    none = lambda c: (F.col(c) == 0, F.col(c))
    return _rows(one, [story], {
        "has_scenes": (F.col("n") > 0, F.col("n")), "starts_with_hero": (F.col("first") == "hero", F.col("first")), "contiguous": (F.col("gap") <= TOLERANCE, F.round("gap", 3)), "positive_duration": none("empty"),
        "scene_duration": budget("longest", SCENE_SECONDS), "no_repeats": none("again"), "figures_in_source": none("loose"), "covers_audio": (F.when(F.col("audio").isNotNull(), F.abs(F.col("end") - F.col("audio")) <= TOLERANCE), F.col("end")),
        "statistic_has_figure": none("bare"), "takeaway_only_last": ((F.col("ends") == 0) | ((F.col("ends") == 1) & (F.col("last") == "takeaway")), F.col("ends")), "cue_duration": budget("cue", CUE_SECONDS), "cue_words": budget("words", CUE_WORDS),
    })
