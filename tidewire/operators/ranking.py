"""Event-level scoring and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import lexicons as X
from tidewire.functions import text as T

from . import classify as C


def recency(published: Column, now: Column, hours: float = X.RECENCY_HOURS) -> Column:
    """1 at ``now``, 0 from ``hours`` before on; an unknown time is 0."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - T.hours_between(now, published) / hours))
    return F.when(published.isNotNull() & now.isNotNull(), near).otherwise(F.lit(0.0))


def momentum(outlets: Column) -> Column:
    return F.least(F.lit(1.0), outlets / X.MOMENTUM_CAP)


def ai_input(version: Column, disposition: Column, legacy: Column) -> Column:
    """Rows of the rules count 1 when accepted; others keep the older score."""
    return F.when(version.isNotNull() & disposition.isin("candidate", "promoted"), F.lit(1.0)).otherwise(F.coalesce(legacy, F.lit(0.0)))


def total(recent: Column, cred: Column, ai: Column, moment: Column, verified: Column) -> Column:
    w = X.SCORE_WEIGHTS
    return w["recency"] * recent + w["credibility"] * cred + w["ai_relevance"] * ai + w["momentum"] * moment + F.when(verified, F.lit(X.VERIFICATION_BONUS)).otherwise(F.lit(0.0))


def event_scores(members: DataFrame, now: Column, table: dict[str, float] = X.CREDIBILITY) -> DataFrame:
    """Of members (canonical, id, source_name, published_at, ai, viable): each event's best member and score.

    Outlets are counted over the whole cluster without collecting it: distinct names by (event, name), less a member's own. The canonical always may
    stand for its event; others only when viable. Ties: the canonical, then the smaller id.
    """
    name = F.lower(F.trim(F.coalesce(F.col("source_name"), F.lit(""))))
    named = members.withColumn("name", name)
    outlets = named.filter("name <> ''").select("canonical", "name").distinct().groupBy("canonical").agg(F.count("*").alias("names"))
    rows = named.join(outlets, "canonical", "left").withColumn("outlets", F.coalesce("names", F.lit(0)) - F.when(F.col("name") != "", 1).otherwise(0))
    cred = C.credibility(F.col("source_name"), table, {})
    rows = rows.withColumn("cred", cred).withColumn("verified", (F.col("outlets") >= 1) | (F.col("cred") >= X.PRIMARY_CREDIBILITY))
    rows = rows.withColumn("score", F.round(total(recency(F.col("published_at"), now), F.col("cred"), F.col("ai"), momentum(F.col("outlets")), F.col("verified")), 9))
    allowed = rows.filter("viable or id = canonical")
    key = F.struct("score", (F.col("id") == F.col("canonical")).alias("own"), (-F.col("id")).alias("low"))
    best = F.max_by(F.struct(F.col("id").alias("best_id"), "source_name", "score", "outlets", "verified"), key)
    return allowed.groupBy("canonical").agg(best.alias("b")).select("canonical", "b.*")


def select_slots(scored: DataFrame, by: str, primary: int = X.PRIMARY_SLOTS, backup: int = X.BACKUP_SLOTS) -> DataFrame:
    """The best events of each ``by``, with position and primary or backup."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "canonical")
    rows = scored.withColumn("rank_position", F.row_number().over(order)).filter(F.col("rank_position") <= primary + backup)
    return rows.withColumn("selection_status", F.when(F.col("rank_position") <= primary, "primary").otherwise("backup"))


def top_up(kept: DataFrame, candidates: DataFrame, by: str, primary: int = X.PRIMARY_SLOTS, backup: int = X.BACKUP_SLOTS) -> DataFrame:
    """Rows that keep their place (``by``, id, rank_position), and the best candidates (``by``, id, score) for what is free, lowest place first."""
    groups = kept.select(by).union(candidates.select(by)).distinct()
    free = groups.select(by, F.explode(F.sequence(F.lit(1), F.lit(primary + backup))).alias("rank_position")).join(kept.select(by, "rank_position"), [by, "rank_position"], "left_anti")
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("rank_position")))
    left = candidates.join(kept.select(by, "id"), [by, "id"], "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= primary + backup)
    added = free.join(left, [by, "nth"]).select(by, "id", "rank_position", F.lit(True).alias("added"))
    rows = kept.select(by, "id", "rank_position", F.lit(False).alias("added")).unionByName(added)
    return rows.withColumn("selection_status", F.when(F.col("rank_position") <= primary, "primary").otherwise("backup"))


def eligible(stories: DataFrame, taken: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Candidates that are canonical, not known to be insufficient, not selected before and no repeat of earlier coverage."""
    rows = stories.filter(F.col("ai_relevance") == "ai_candidate").filter(F.col("canonical_story_id").isNull()).filter(~F.col("source_sufficiency").eqNullSafe("insufficient"))
    return rows.join(taken.select("id"), "id", "left_anti").join(duplicates.select("id"), "id", "left_anti")
