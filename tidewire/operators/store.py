"""Tables of the engine: stages that can run again, and what changes an episode.

No table format with transactions is at hand, so a stage overwrites the partitions of its day, and uniqueness is an anti join. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import append_missing


def write_day(df: DataFrame, path: str, by: str = "collection_date") -> None:
    """A stage's commit: the days that ``df`` holds are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_day(spark: SparkSession, path: str, day, by: str = "collection_date") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(by) == F.lit(day))


def still_to_do(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def stale(details: Column, fingerprint: str) -> Column:
    """Whether a stored verdict is missing or came from other code."""
    return ~F.coalesce(F.get_json_object(details, "$.fingerprint") == fingerprint, F.lit(False))


def retry(status: Column, details: Column) -> Column:
    """Failed fetches are tried once more."""
    return status.isin("fetch_error", "empty_extraction") & F.get_json_object(details, "$.refetched").isNull()


def save_verdicts(known: DataFrame, new: DataFrame) -> DataFrame:
    """Insert only: one verdict for a story, its match and the method's version."""
    return append_missing(known, new.withColumn("development_match", F.substring("development_match", 1, 120)), ["story_id", "matched_story_id", "method_version"])


def effective(override: Column, decision: Column) -> Column:
    return F.coalesce(override, decision)


def best_relation(relations: DataFrame, version: str) -> DataFrame:
    """Of each story: the duplicate, else the verdict, of highest similarity; the smaller match on ties."""
    key = F.struct((effective(F.col("editor_override"), F.col("decision")) == "duplicate").alias("d"), "semantic_similarity", (-F.col("matched_story_id")).alias("m"))
    return relations.filter(F.col("method_version") == version).groupBy("story_id").agg(F.max_by(F.struct("matched_story_id", "decision", "semantic_similarity", "reason"), key).alias("b")).select("story_id", "b.*")


def reorder(rows: DataFrame, wanted: DataFrame, by: str = "episode_id") -> DataFrame:
    """Rows (by, id, rank_position) in the order of wanted (by, id, nth): the group's own positions are dealt anew; the rest stay."""
    moved = rows.join(wanted, [by, "id"])
    place = moved.select(by, "rank_position").withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("rank_position")))
    turn = moved.select(by, "id", "nth").withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("nth", "id")))
    return turn.join(place, [by, "n"]).select(by, "id", "rank_position").unionByName(rows.select(by, "id", "rank_position").join(wanted.select(by, "id"), [by, "id"], "left_anti"))


def swap(rows: DataFrame, a: int, b: int) -> DataFrame:
    """Two stories exchange position and status. If one is missing nothing changes."""
    pair = rows.filter(F.col("story_id").isin(a, b)).select(F.when(F.col("story_id") == a, b).otherwise(a).alias("story_id"), F.col("rank_position").alias("p"), F.col("selection_status").alias("s"), F.count("*").over(Window.partitionBy("episode_id")).alias("both"), "episode_id").filter("both = 2")
    joined = rows.join(pair, ["episode_id", "story_id"], "left")
    return joined.withColumn("rank_position", F.coalesce("p", "rank_position")).withColumn("selection_status", F.coalesce("s", "selection_status")).drop("p", "s", "both")


def plan_swap(primary: list[int], backup: list[int], a: int, b: int) -> dict | None:
    """Across groups a swap, inside one the group's new order, else nothing."""
    if a == b:
        return None
    for group in (primary, backup):
        if a in group and b in group:
            return {"reorder": [b if x == a else a if x == b else x for x in group]}
    return {"swap": [a, b]} if {a, b} <= {*primary, *backup} else None


def reprocess(selected: DataFrame, episode_id: int) -> DataFrame:
    """What counts as selected before when an episode is made again: all but its own rows, or its primaries would exclude themselves."""
    return selected.filter((F.col("episode_id") != episode_id) & (F.col("selection_status") == "primary")).select(F.col("story_id").alias("id")).distinct()


def may_update(episodes: DataFrame) -> DataFrame:
    """(episode_date, verdict): created where none is, topped up while a draft, refused when decided, published or ambiguous."""
    one = episodes.groupBy("episode_date").agg(F.count("id").alias("n"), F.max("status").alias("status"), F.max("publish_status").alias("published"))
    verdict = F.when(F.col("n") > 1, "refused: more than one episode").when(F.col("published").isin("published", "publishing"), "refused: published").when(F.col("status").isin("approved", "rejected"), F.concat(F.lit("refused: "), F.col("status"))).when(F.col("n") == 0, "create").otherwise("update")
    return one.select("episode_date", verdict.alias("verdict"))


def next_publication(publications: DataFrame, repost: bool = False) -> DataFrame:
    """(episode_id, environment, sequence, action): a failed one is tried again in place, else the next number; while publishing, or published without ``repost``, refused."""
    last = publications.groupBy("episode_id", "environment").agg(F.max(F.struct("sequence", "status")).alias("l"))
    busy = (F.col("l.status") == "publishing") | ((F.col("l.status") == "published") & ~F.lit(repost))
    action = F.when(busy, "refused").when(F.col("l.status") == "failed", "retry").otherwise("insert")
    return last.select("episode_id", "environment", F.when(action == "insert", F.col("l.sequence") + 1).otherwise(F.col("l.sequence")).alias("sequence"), action.alias("action"))


def invalidate(content: DataFrame, edited: DataFrame, episodes: DataFrame, members: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """After script edits (story_id, script_text): artefacts that came from the old text go, and every episode with such a story is stamped."""
    new = edited.select("story_id", F.col("script_text").alias("new_text"))
    joined = content.join(new, "story_id", "left")
    hit = F.col("new_text").isNotNull()
    out = joined.select(*((F.when(hit, F.col("new_text")).otherwise(F.col(c)) if c == "script_text" else F.when(hit, F.lit(None).cast(t)).otherwise(F.col(c)) if c in ("audio_path", "audio_duration_seconds", "caption_segments", "video_path") else F.when(hit, F.lit("edited")).otherwise(F.col(c)) if c == "script_quality_status" else F.col(c)).alias(c) for c, t in content.dtypes))
    touched = members.join(new.select("story_id"), "story_id", "left_semi").select(F.col("episode_id").alias("id")).distinct().withColumn("touched", F.lit(True))
    stamped = episodes.join(touched, "id", "left").withColumn("content_changed_at", F.when(F.col("touched"), now).otherwise(F.col("content_changed_at"))).drop("touched")
    return out, stamped


def reclassify_legacy(stories: DataFrame, verdict: Column) -> DataFrame:
    """Rows in the retired state are judged anew, and say so."""
    old = F.col("ai_relevance") == "ai_review"
    said = F.when(verdict["disposition"] == "candidate", "ai_candidate").otherwise("not_ai")
    return stories.withColumn("filter_reason", F.when(old, F.concat(F.lit("Re-evaluated: "), verdict["reason"])).otherwise(F.col("filter_reason"))).withColumn("ai_relevance", F.when(old, said).otherwise(F.col("ai_relevance")))
