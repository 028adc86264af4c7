"""What the service's routes return, as DataFrames. The HTTP layer and media are out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import store as S
from tidewire.operators import windows as W


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def collection_runs(runs: DataFrame, limit: int = 20, day=None) -> DataFrame:
    rows = runs if day is None else runs.filter(F.col("collection_date") == F.lit(day))
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(clamp(limit, 100))


def notifications(rows: DataFrame, limit: int = 50) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(clamp(limit, 200))


def episodes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """All episodes, latest first, with how many stories of each kind they hold: one aggregation for all."""
    n = lambda s: F.count_if(F.col("selection_status") == s)
    counts = members.groupBy(F.col("episode_id").alias("id")).agg(n("primary").alias("primary_count"), n("backup").alias("backup_count"))
    return rows.join(counts, "id", "left").fillna(0, ["primary_count", "backup_count"]).orderBy(F.desc("episode_date"), F.desc("id"))


def latest_episode(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("episode_date"), F.desc("id")).limit(1)


def episode_documents(rows: DataFrame, members: DataFrame, items: DataFrame, stories: DataFrame, content: DataFrame) -> DataFrame:
    """(id, document): episodes as nested JSON with their stories in order; 30 to an episode at most."""
    joined = members.join(items, members["story_id"] == items["id"]).drop(items["id"]).join(stories, members["story_id"] == stories["id"]).drop(stories["id"]).join(content.withColumnRenamed("story_id", "__s"), F.col("story_id") == F.col("__s"), "left")
    one = F.struct("rank_position", "selection_status", "story_id", "title", "source_name", "canonical_url", "taxonomy_category", "verification_status", "script_text")
    listed = joined.groupBy(F.col("episode_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("stories"))
    return rows.join(listed, "id", "left").select("id", F.to_json(F.struct("id", "episode_date", "status", "stories")).alias("document"))


def duplicates(items: DataFrame, stories: DataFrame, story_id: int) -> DataFrame:
    """The stories that hang on this one, or on what it hangs on."""
    own = stories.filter(F.col("id") == story_id).select(F.coalesce("canonical_story_id", "id").alias("head"))
    group = stories.join(own, F.coalesce("canonical_story_id", stories["id"]) == F.col("head")).filter(F.col("id") != story_id).select("id", "dedup_reason")
    return group.join(items.select("id", "title", "source_name", "published_at"), "id").orderBy("id")


def publish_summary(publications: DataFrame) -> DataFrame:
    """(episode_id, status): publishing before published before failed."""
    has = lambda s: F.max(F.col("status") == s)
    return publications.groupBy("episode_id").agg(F.when(has("publishing"), "publishing").when(has("published"), "published").when(has("failed"), "failed").otherwise("not_published").alias("publish_status"))


def post(rows: DataFrame) -> DataFrame:
    """(id, text) of the post about a published episode: dated, with what it leads with, and a share address."""
    from tidewire.functions import text as T

    day = F.date_format("episode_date", "dd/MM/yyyy")
    head = F.concat(F.lit("AI news of "), day, F.lit("\n"), F.col("headline"), F.lit("\n"), F.col("video_url"))
    return rows.select("id", head.alias("text"), F.concat(F.lit("https://www.linkedin.com/feed/?shareActive=true&text="), T.percent_encode(head)).alias("share_url"))


def video_metadata(members: DataFrame, most: int = 4900) -> DataFrame:
    """(episode_id, description): numbered titles in order, cut to what a description may hold."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank_position", "title"))), lambda x: F.concat(x["rank_position"].cast("string"), F.lit(". "), x["title"]))
    text = members.filter("selection_status = 'primary'").groupBy("episode_id").agg(F.array_join(lines, "\n").alias("t"))
    return text.select("episode_id", F.when(F.length("t") > most, F.concat(F.left("t", F.lit(most - 3)), F.lit("..."))).otherwise(F.col("t")).alias("description"))


def latest_run(runs: DataFrame) -> DataFrame:
    return W.latest(runs, ["collection_date"], [F.desc("started_at"), F.desc("id")])


def relations(rows: DataFrame, items: DataFrame, members: DataFrame, episodes_: DataFrame, version: str) -> DataFrame:
    """The best relation of each story, with its match's title and first date of publication."""
    first = members.join(episodes_.select(F.col("id").alias("episode_id"), "episode_date"), "episode_id").groupBy(F.col("story_id").alias("matched_story_id")).agg(F.min("episode_date").alias("first_published"))
    best = S.best_relation(rows, version)
    return best.join(items.select(F.col("id").alias("matched_story_id"), "title"), "matched_story_id", "left").join(first, "matched_story_id", "left")


def discovery(items: DataFrame) -> DataFrame:
    """Where a story was found, for those of the story search."""
    found = F.when((F.col("source_type") == "hackernews") & (F.coalesce("external_id", F.lit("")) != ""), F.struct(F.lit("Hacker News").alias("channel"), F.concat(F.lit("https://news.ycombinator.com/item?id="), "external_id").alias("url")))
    return items.select("id", found.alias("discovery"))


def systematic(rows: DataFrame, key: str, n: int) -> DataFrame:
    return W.stride_sample(rows, key, n)


def positions(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("rank_position", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rank_score"), "story_id")))


def qa_is_stale(rows: DataFrame) -> DataFrame:
    """(id, stale): produced, and never checked or changed since."""
    later = lambda c: F.coalesce(F.col(c) > F.col("qa_run_at"), F.lit(False))
    stale = F.col("video_produced_at").isNotNull() & (F.col("qa_run_at").isNull() | later("video_produced_at") | later("content_changed_at"))
    return rows.select("id", stale.alias("stale"))


def valid_artefacts(artefacts: DataFrame, content: DataFrame) -> DataFrame:
    """Artefacts (story_id, written_at) no older than their story's content."""
    return artefacts.join(content.select("story_id", "updated_at"), "story_id").filter("written_at >= updated_at").drop("updated_at")


def qa_rows(episodes_: DataFrame, members: DataFrame, items: DataFrame, stories: DataFrame, status: str = "video_ready") -> DataFrame:
    """The primaries that an episode's checks read."""
    one = episodes_.filter(F.col("video_status") == status).select(F.col("id").alias("episode_id"), "episode_date")
    picked = members.filter("selection_status = 'primary'").join(one, "episode_id")
    return picked.join(items.withColumnRenamed("id", "story_id"), "story_id").join(stories.withColumnRenamed("id", "story_id"), "story_id")


def slowest(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc("seconds"), "id").limit(n)


def one_vocabulary(new: DataFrame, historical: DataFrame) -> DataFrame:
    """New and published texts (id, text) as one collection, with their side."""
    return new.select("id", "text", F.lit("new").alias("side")).unionByName(historical.select("id", "text", F.lit("historical").alias("side")))


def named_company(title, source, companies: dict[str, str], sources: dict[str, str] | None = None):
    """The one company (name: pattern) that a title names; none if it names several; where it names none, that of its source."""
    hits = lambda text, table: F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in table.items())))
    found = hits(F.coalesce(title, F.lit("")), companies)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) == 0, F.get(hits(F.coalesce(source, F.lit("")), sources or {}), F.lit(0)) if sources else F.lit(None).cast("string"))
