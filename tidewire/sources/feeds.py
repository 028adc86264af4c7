"""Collection: feeds as a data source with one partition for each feed, identity by source, and the run's ledger."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEM = "source_name string, source_type string, external_id string, canonical_url string, title string, author string, published_at timestamp, raw_summary string, outcome string"
RETRIED, ATTEMPTS, POINTS, PAGE = (429, 500, 502, 503, 504), 2, 15, 100


def fetch(url: str, timeout: float = 10.0) -> bytes:
    """Two attempts, the second after a timeout, a lost connection or a status that may pass."""
    for left in range(ATTEMPTS - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "tidewire"}), timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if not left or e.code not in RETRIED:
                raise
        except (urllib.error.URLError, TimeoutError):
            if not left:
                raise
    raise AssertionError


def published(text: str | None) -> datetime | None:
    """An instant in any usual format; without a zone it is UTC; null where nothing fits."""
    for parse in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            t = parse((text or "").strip())
            return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        except (TypeError, ValueError, IndexError):
            continue
    return None


def entries(xml: bytes) -> list[dict]:
    """Items of an RSS or Atom document."""
    out = []
    for item in (e for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] in ("item", "entry")):
        got: dict[str, str] = {}
        for c in item:
            name = c.tag.rpartition("}")[2]
            got.setdefault(name, (c.text or c.get("href") or "").strip())
        out.append({"title": got.get("title"), "link": got.get("link"), "id": got.get("guid") or got.get("id"), "summary": got.get("description") or got.get("summary"), "author": got.get("author") or got.get("creator"), "published": got.get("pubDate") or got.get("published") or got.get("updated")})
    return out


def outcome(e: dict, start: datetime, end: datetime) -> tuple[datetime | None, str]:
    """Bad and late rows are marked, not dropped, so the ledger can count them."""
    t = published(e.get("published"))
    if not e.get("title") or not e.get("link") or t is None:
        return t, "invalid"
    return t, "inside" if start <= t <= end else "outside_window"


class _Feed(InputPartition):
    def __init__(self, name: str, url: str):
        self.name, self.url = name, url


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.feeds = json.loads(options["feeds"])  # a list of [name, address]
        self.start, self.end = (published(options[k]) for k in ("start", "end"))

    def partitions(self):
        return [_Feed(*f) for f in self.feeds]

    def read(self, p: _Feed):
        try:
            found = entries(fetch(p.url))
        except Exception as e:  # one feed's failure is its own
            yield (p.name, "rss", None, None, None, None, None, str(e)[:200], "failed")
            return
        for e in found:
            t, said = outcome(e, self.start, self.end)
            yield (p.name, "rss", e["id"], e["link"], e["title"], e["author"], t, e["summary"], said)


class FeedSource(DataSource):
    """``spark.read.format("tidewire_feeds").option("feeds", json).option("start", iso).option("end", iso)``."""

    @classmethod
    def name(cls):
        return "tidewire_feeds"

    def schema(self):
        return ITEM

    def reader(self, schema):
        return FeedReader(self.options)


class StoryReader(DataSourceReader):
    """Pages of a story search whose conditions the service applies: more points than the least, strictly inside the window in whole seconds."""

    def __init__(self, options: dict):
        self.url, self.pages = options["url"], int(options.get("pages", 10))
        self.low, self.high = (int(published(options[k]).timestamp()) for k in ("start", "end"))

    def partitions(self):
        return [InputPartition(k) for k in range(self.pages)]

    def read(self, p):
        conditions = f"points>{POINTS},created_at_i>{self.low},created_at_i<{self.high}"
        hits = json.loads(fetch(f"{self.url}?tags=story&hitsPerPage={PAGE}&page={p.value}&numericFilters={conditions}")).get("hits", [])
        for h in hits:
            url, said = story_fallbacks(h)
            yield ("Hacker News", "hackernews", h.get("objectID"), url, h.get("title"), h.get("author"), published(h.get("created_at")), said, "inside" if h.get("title") else "invalid")


class StorySource(FeedSource):
    @classmethod
    def name(cls):
        return "tidewire_stories"

    def reader(self, schema):
        return StoryReader(self.options)


def story_fallbacks(hit: dict, described: str | None = None) -> tuple[str, str]:
    """A story's address, else its discussion; its text, else its page's description, else points and comments."""
    url = hit.get("url") or f"https://news.ycombinator.com/item?id={hit.get('objectID')}"
    return url, hit.get("story_text") or described or f"{hit.get('points') or 0} points, {hit.get('num_comments') or 0} comments"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(StorySource)


def upsert(known: DataFrame, arrived: DataFrame, now: Column) -> DataFrame:
    """The item table after a pass: known by (source, external id), else by (source, address); a hit only refreshes ``collected_at``. Of rows that arrive twice one counts."""
    arrived = arrived.filter("outcome = 'inside'").dropDuplicates(["source_name", "canonical_url"])
    by_id = known.filter("external_id is not null").select("source_name", "external_id", F.col("canonical_url").alias("k1"))
    by_url = known.select("source_name", "canonical_url", F.col("canonical_url").alias("k2"))
    matched = arrived.join(by_id, ["source_name", "external_id"], "left").join(by_url, ["source_name", "canonical_url"], "left").withColumn("known_url", F.coalesce("k1", "k2"))
    hits = matched.filter("known_url is not null").select(F.col("source_name").alias("s"), F.col("known_url").alias("u")).distinct()
    kept = known.join(hits, (F.col("source_name") == F.col("s")) & (F.col("canonical_url") == F.col("u")), "left").withColumn("collected_at", F.when(F.col("u").isNotNull(), now).otherwise(F.col("collected_at"))).drop("s", "u")
    fresh = matched.filter("known_url is null").withColumn("collected_at", now)
    return kept.unionByName(fresh.select(*(c for c in known.columns)))


def ledger(arrived: DataFrame, started: Column, trigger: str = "scheduled") -> DataFrame:
    """One row for a run: counts by outcome; failed if any source failed."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return arrived.agg(F.count("*").alias("seen"), n("inside").alias("inside"), n("outside_window").alias("outside_window"), n("invalid").alias("invalid"), n("failed").alias("errors")).withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("completed")).withColumn("started_at", started).withColumn("trigger_type", F.lit(trigger))
