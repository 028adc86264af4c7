"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sources get shares of the words to take by weight; a source that would exceed its cap stops there and the excess is
shared anew among the others (water filling). The shares become whole blocks of equal size by highest quotients
share / (2k + 1): first among sources, then among groups of shards, then among the shards of each group. In a shard the documents stand in a seeded
order and form a ring of blocks; whole rounds of the ring are taken first, and the rest from a seeded block on.

A shard holds about ``shard_words`` words, so a source with a third of all rows is many tasks. A document's place comes
from its id and its text, so rows that share an id, or have none, spread over shards as well.

Defined results: a null text has size 0 and nothing taken; a null source is a source of its own, last in order; rows
that repeat a doc_id are counted and taken each; a null doc_id takes part. In the mixed
documents those without words do not appear. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, Tables

#: Quotas differ from exact shares by fewer than this many blocks, so quotients outside this window need no look.
NEAR = 2
#: Shards that share a group's quota: sources hand out to groups, groups to shards, so that no task ranks more than this or the number of groups.
GROUP = 1024


def seeded(seed: int, *cols: Column) -> Column:
    """A hexadecimal digest of a seed and values; it orders rows at random but always alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols)).cast("binary"))


def number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sainte_lague(df: DataFrame, group: list[str], key: list[str], share: str, seats: str) -> DataFrame:
    """``df`` with ``quota``: whole seats of each row. Each group hands out ``seats`` to its rows, always to the highest share / (2k + 1)."""
    every = Window.partitionBy(*group)
    total = F.sum(share).over(every)
    exact = F.when(total > 0, F.col(seats) * F.col(share) / total).otherwise(F.lit(0.0))
    base = df.withColumn("__base", F.greatest(F.lit(0), F.floor(exact) - NEAR).cast("long"))
    base = base.withColumn("__left", F.col(seats) - F.sum("__base").over(every))
    one = base.select(*group, *key, share, "__base", "__left", F.explode(F.sequence(F.col("__base"), F.col("__base") + 3 * NEAR)).alias("__k")).filter(F.col(share) > 0)
    rank = F.row_number().over(every.orderBy((F.col(share) / (2 * F.col("__k") + 1)).desc(), *(F.col(k).asc_nulls_last() for k in key), F.col("__k")))
    won = one.withColumn("__rank", rank).filter("__rank <= __left").groupBy(*group, *key).agg(F.count("*").alias("__won"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*group, *key]]
    joined = base.alias("b").join(won.alias("w"), same, "left")
    return joined.select(*(F.col(f"b.{c}") for c in df.columns), (F.col("b.__base") + F.coalesce("w.__won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, shard_words: int = 1 << 18, block_words: int = 1024, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source), and where in its shard's ring it lies."""
    tables = Tables(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    order = seeded(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = tables.keep(docs.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), size.alias("__size"), order.alias("__order"), *(F.col(c).alias(f"__c_{c}") for c in carry)), "sized")

    everything = Window.partitionBy()
    sources = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    sources = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double"))
    sources = sources.withColumn("most", cap * F.col("source_size")).withColumn("all", share * F.sum("source_size").over(everything)).withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", "nth")
    spent = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("all") - spent) / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", level).withColumn("free", F.col("level") < F.col("ratio"))
    sources = sources.withColumn("target", F.when(F.col("free"), F.max(F.when(F.col("free"), F.col("level"))).over(everything) * F.col("weight")).otherwise(F.col("most")))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.coalesce(F.floor(smallest / 64), F.lit(1)))).cast("long"))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    sources = sainte_lague(sources.select("__source", "nth", "source_size", "target", "block", "seats"), [], ["nth"], "target", "seats")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = tables.keep(sources.select("__source", "nth", "source_size", "target", "block", F.col("quota").alias("source_quota"), "shards"), "sources")

    placed = sized.join(sources, sized["__source"].eqNullSafe(sources["__source"])).drop(sources["__source"])
    placed = placed.withColumn("__shard", number(F.col("__order")) % F.col("shards"))
    shards = placed.groupBy("nth", "__shard").agg(F.sum("__size").cast("double").alias("words"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    shards = tables.keep(shards.withColumn("__group", F.floor(F.col("__shard") / GROUP).cast("long")), "sizes")
    groups = shards.groupBy("nth", "__group").agg(F.sum("words").alias("words"), F.first("source_quota").alias("source_quota"))
    groups = sainte_lague(groups, ["nth"], ["__group"], "words", "source_quota").select("nth", "__group", F.col("quota").alias("group_quota"))
    shards = sainte_lague(shards.join(groups, ["nth", "__group"]), ["nth", "__group"], ["__shard"], "words", "group_quota")
    take = F.least(F.col("quota") * F.col("block"), (cap * F.col("words")).cast("long"))
    shards = shards.select("nth", "__shard", F.col("words").cast("long").alias("words"), take.alias("take"))
    shards = shards.withColumn("rounds", F.when(F.col("words") > 0, F.expr("take div words")).otherwise(F.lit(0)).cast("long"))
    shards = tables.keep(shards.withColumn("rest", F.col("take") - F.col("rounds") * F.col("words")), "shards")

    ring = Window.partitionBy("nth", "__shard").orderBy("__order", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__end", F.sum("__size").over(ring)).join(shards, ["nth", "__shard"])
    begin, end = F.col("__end") - F.col("__size"), F.col("__end")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block")))
    first = (number(seeded(seed, F.lit("block"), F.col("nth"), F.col("__shard"))) % blocks) * F.col("block")
    stop = first + F.col("rest")
    within = lambda low, high: F.greatest(F.lit(0), F.least(end, high) - F.greatest(begin, low))
    placed = placed.withColumn("__part", (within(first, F.least(stop, F.col("words"))) + within(F.lit(0), F.greatest(F.lit(0), stop - F.col("words")))).cast("long"))
    placed = placed.withColumn("__from", F.when(begin < first, F.when(stop - F.col("words") > begin, F.lit(0)).otherwise(first - begin)).otherwise(F.lit(0)))
    return placed.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("rounds") * F.col("__size") + F.col("__part")).alias("taken"),
        *([F.col("rounds").alias("__rounds"), F.col("__part").alias("__part"), F.col("__from").cast("long").alias("__from"), *(F.col(f"__c_{c}") for c in carry)] if carry else []),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy taken, and one of the words taken from a document in part."""
    columns = docs.columns
    rows = mix(docs, carry=tuple(columns), **options)
    rows = rows.withColumn("__copy", F.explode(F.concat(F.sequence(F.lit(1), F.lit(2)), F.array(F.lit(0)))))
    whole = F.col("__c_text")
    words = F.array_remove(F.split(whole, f"[{SPACE}]+"), "")
    part = F.when(F.col("__part") == F.col("size"), whole).otherwise(F.array_join(F.concat(F.slice(words, F.col("__from").cast("int") + 1, F.col("__part").cast("int"))), " "))
    rows = rows.filter("(__copy > 0 and __copy <= __rounds and size > 0) or (__copy = 0 and __part > 0)")
    rows = rows.withColumn("__text", F.when(F.col("__copy") > 0, whole).otherwise(part))
    out = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return rows.select(*(out.get(c, F.col(f"__c_{c}")).alias(c) for c in columns))
