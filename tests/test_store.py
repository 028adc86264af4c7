"""What changes tables: running twice is the same as once, and nothing else moves."""

from pyspark.sql import functions as F

from tidewire.functions import lexicons as X
from tidewire.operators import joins as J
from tidewire.operators import ranking as R
from tidewire.operators import store as S
from tidewire.operators import windows as W
from tidewire.sources import feeds, pages


def test_day_overwrite_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([("2026-09-20", 1), ("2026-09-21", 2)], "collection_date string, id int")
    for _ in range(2):
        S.write_day(df, f"{tmp_path}/t")
    S.write_day(df.filter("id = 2").withColumn("id", F.lit(9)), f"{tmp_path}/t")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 9]


def test_upsert_by_id_then_address(spark):
    t0, t1 = (F.to_timestamp(F.lit(x)) for x in ("2026-09-20 01:00:00", "2026-09-20 02:00:00"))
    row = "source_name string, external_id string, canonical_url string, title string, outcome string"
    known = spark.createDataFrame([("a", "1", "u1", "t"), ("a", None, "u2", "t")], "source_name string, external_id string, canonical_url string, title string").withColumn("collected_at", t0)
    new = spark.createDataFrame([("a", "1", "moved", "t", "inside"), ("a", "7", "u2", "t", "inside"), ("b", None, "u1", "t", "inside"), ("b", None, "late", "t", "outside_window")], row)
    out = feeds.upsert(known, new, t1)
    again = feeds.upsert(out, new, t1)
    key = lambda df: sorted((r["source_name"], r["canonical_url"], str(r["collected_at"])) for r in df.collect())
    assert key(out) == key(again) == [("a", "u1", "2026-09-20 02:00:00"), ("a", "u2", "2026-09-20 02:00:00"), ("b", "u1", "2026-09-20 02:00:00")]


def test_top_up_keeps_and_fills_lowest_first(spark):
    kept = spark.createDataFrame([("e", 1, 2), ("e", 2, 4)], "ep string, id int, rank_position int")
    cand = spark.createDataFrame([("e", 1, 9.0), ("e", 3, 5.0), ("e", 4, 8.0), ("e", 5, 1.0)], "ep string, id int, score double")
    got = {r["rank_position"]: (r["id"], r["selection_status"]) for r in R.top_up(kept, cand, "ep", 3, 2).collect()}
    assert got == {1: (4, "primary"), 2: (1, "primary"), 3: (3, "primary"), 4: (2, "backup"), 5: (5, "backup")}


def test_reorder_and_swap(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (1, 12, 4), (1, 13, 26)], "episode_id int, id int, rank_position int")
    wanted = spark.createDataFrame([(1, 12, 0), (1, 10, 1), (1, 11, 2)], "episode_id int, id int, nth int")
    assert {r["id"]: r["rank_position"] for r in S.reorder(rows, wanted).collect()} == {12: 1, 10: 3, 11: 4, 13: 26}
    eps = spark.createDataFrame([(1, 10, 1, "primary"), (1, 13, 26, "backup"), (1, 14, 2, "primary")], "episode_id int, story_id int, rank_position int, selection_status string")
    assert {r["story_id"]: (r["rank_position"], r["selection_status"]) for r in S.swap(eps, 10, 13).collect()} == {10: (26, "backup"), 13: (1, "primary"), 14: (2, "primary")}
    assert S.swap(eps, 10, 99).filter("story_id = 10").first()["rank_position"] == 1
    assert S.plan_swap([1, 2], [3], 1, 3) == {"swap": [1, 3]} and S.plan_swap([1, 2], [3], 1, 2) == {"reorder": [2, 1]} and S.plan_swap([1], [3], 1, 9) is None


def test_running_offset_skips_the_silent(spark):
    rows = spark.createDataFrame([("e", i, d) for i, d in enumerate([10.896, 24.552, None, 5.0])], "e string, n int, d double")
    got = [r["starts_at"] and round(r["starts_at"], 3) for r in W.running_offset(rows, "e", "n", "d").orderBy("n").collect()]
    assert got == [8.1, 19.596, None, 44.748]


def test_window_pairs_equal_the_plain_condition(spark):
    rows = spark.sql("select id, timestamp_seconds(id * 7919 * 13 % 1000000) ts from range(150) union all select 999, null")
    got = {(r["e_id"], r["l_id"]) for r in J.window_pairs(rows, "ts", "id", 48, salts=3).collect()}
    at = {r["id"]: r["ts"].timestamp() for r in rows.collect() if r["ts"]}
    assert got == {(a, b) for a in at for b in at if (at[a], a) < (at[b], b) and at[b] - at[a] <= 48 * 3600}


def test_tokens_in_common_equal_brute_force(spark):
    sets = {i: {f"t{(i * 7 + k * k) % 23}" for k in range(2 + i % 5)} | {"the"} for i in range(40)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, t array<string>")
    got = {(r["a"], r["b"]) for r in J.tokens_in_common(df, "id", "t", 0.5).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def test_selection_limits(spark):
    rows = spark.range(40).select(F.lit("d").alias("day"), F.col("id").alias("canonical"), (F.col("id") % 7).cast("double").alias("score"))
    got = R.select_slots(rows, "day").collect()
    assert len(got) == X.PRIMARY_SLOTS + X.BACKUP_SLOTS and sum(r["selection_status"] == "primary" for r in got) == X.PRIMARY_SLOTS


def test_publication_rules(spark):
    p = spark.createDataFrame([(1, "x", 1, "failed"), (2, "x", 1, "published"), (3, "x", 2, "publishing")], "episode_id int, environment string, sequence int, status string")
    assert {r["episode_id"]: (r["sequence"], r["action"]) for r in S.next_publication(p).collect()} == {1: (1, "retry"), 2: (1, "refused"), 3: (2, "refused")}
    assert S.next_publication(p, repost=True).filter("episode_id = 2").first()["sequence"] == 2


def test_feed_items_and_fallbacks():
    xml = b"<rss><channel><item><title>T</title><link>http://a/1</link><pubDate>Sun, 20 Sep 2026 10:00:00 GMT</pubDate><guid>g</guid></item><item><title>No date</title><link>http://a/2</link></item></channel></rss>"
    items = feeds.entries(xml)
    start, end = feeds.published("2026-09-20T00:00:00Z"), feeds.published("2026-09-20T23:59:59+00:00")
    assert [feeds.outcome(e, start, end)[1] for e in items] == ["inside", "invalid"]
    assert feeds.outcome(items[0] | {"published": "2026-09-19T23:00:00"}, start, end)[1] == "outside_window"
    assert feeds.story_fallbacks({"objectID": "5", "points": 20, "num_comments": 3}) == ("https://news.ycombinator.com/item?id=5", "20 points, 3 comments")


def test_pages():
    long = "word " * 60
    assert pages.description('<meta content="A long enough description." property="og:description"><meta name=description content="other one that is long">') == "A long enough description."
    assert pages.description(f"<p>short</p><p>{long}</p>").startswith("word word")
    assert pages.body(f"<nav><p>menu</p></nav><article><p>{long}</p></article>")[1:] == ("success", "paragraphs")
    assert pages.body('<script type="application/ld+json">{"@graph":[{"articleBody":"' + "x" * 250 + '"}]}</script>')[2] == "json_ld"
    assert pages.body(f"<p>{long}</p><p>Subscribe to continue</p>")[1] == "partial" and pages.body("<p>a</p>")[1] == "empty_extraction" and pages.body(None)[1] == "non_html"
