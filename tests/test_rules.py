"""Decision lists and ladders on literal inputs."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import classify as C
from tidewire.operators import dedup as D
from tidewire.operators import joins as J
from tidewire.operators import ranking as R
from tidewire.plans import catalogue

SF = "/root/testdata/sf0.001"


def verdict(spark, title, summary=None):
    df = spark.createDataFrame([(title, summary)], "t string, s string")
    return df.select(C.relevance_rules(F.col("t"), F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "title,summary,disposition,flag",
    [
        ("OpenAI launches a new coding agent for enterprises", None, "candidate", None),
        ("Anthropic plans to open an office in Tokyo", None, "candidate", None),
        ("Best AI laptop deals for Prime Day", None, "reject", "deal"),
        ("How to build an AI agent in ten minutes", None, "reject", "tut"),
        ("Why we should worry about AI", None, "reject", "opin"),
        ("Is ChatGPT getting worse?", None, "reject", "ask"),
        ("City council approves new bus routes", None, "reject", None),
        ("Startup raises $40 million", "The company trains a large language model.", "candidate", None),
        ("Startup has a plain headline", '<a href="https://ai.example/openai">link</a>', "reject", None),
        ("Robots in a quiet warehouse", None, "reject", None),
        (None, None, "reject", None),
    ],
)
def test_relevance(spark, title, summary, disposition, flag):
    r = verdict(spark, title, summary)
    assert (r["disposition"], r["content_flag"]) == (disposition, flag)
    assert r["version"] == "rules-v3"


BASE = {
    "same_source": False, "sim": 0.9, "title_sim": 0.9, "subject": "shared", "new_types": ["launch"], "new_source": "title", "old_types": ["launch"], "old_source": "title", "covered": ["launch"],
    "numbers": 0, "title_entities": 0, "material": False, "lead_novelty": 0.1, "title_only": False, "first_person": False, "explains": False, "old_explains": False,
}


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"same_source": True}, "identical_source"), ({"sim": 0.5}, "unrelated"), ({"subject": "disjoint"}, "different_subject"),
        ({"new_types": ["pricing"]}, "new_development_type"), ({"new_types": ["feature"], "sim": 0.85}, "same_development_other_verb"),
        ({"new_types": ["feature"], "material": True}, "different_development"), ({"first_person": True}, "first_hand_account"), ({"explains": True}, "explainer_coverage"),
        ({"title_only": True}, "headline_evidence"), ({"title_only": True, "numbers": 1}, "limited_evidence"), ({"numbers": 1}, "launch_new_numbers"), ({}, "same_launch"),
        ({"new_types": ["funding"], "old_types": ["funding"], "covered": ["funding"], "numbers": 2}, "development_new_numbers"),
        ({"new_types": ["funding"], "old_types": ["funding"], "covered": ["funding"]}, "same_development"),
        ({"new_types": ["update"], "old_types": ["update"], "lead_novelty": 0.6}, "incremental_new_content"), ({"title_sim": 0.2}, "insufficient_overlap"),
        ({"new_types": ["other"], "sim": 0.95}, "near_identical_coverage"), ({"new_types": ["other"], "sim": 0.8}, "development_unconfirmed"),
    ],
)
def test_ladder(spark, change, rule):
    v = BASE | change
    schema = "same_source boolean, sim double, title_sim double, subject string, new_types array<string>, new_source string, old_types array<string>, old_source string, covered array<string>, numbers int, title_entities int, material boolean, lead_novelty double, title_only boolean, first_person boolean, explains boolean, old_explains boolean"
    df = spark.createDataFrame([tuple(v.values())], schema)
    p = {k: F.col(k) for k in v} | {s: F.struct(F.col(f"{s}_types").alias("types"), F.col(f"{s}_source").alias("source")) for s in ("new", "old")}
    assert df.select(D.decide(p).alias("d")).first()["d"]["rule"] == rule


def naive_walk(rows, pairs):
    heads, out = [], {}
    for i, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        fits = [(-s, h) for h in heads for a, b, s in pairs if {a, b} == {i, h}]
        out[i] = min(fits)[1] if fits else None
        if not fits:
            heads.append(i)
    return out


def test_walk_matches_plain_loop(spark):
    rows = [(i, i // 2) for i in range(12)]
    pairs = [(i, j, round(0.4 + ((i * 7 + j * 3) % 11) / 20, 3)) for i in range(12) for j in range(i + 1, 12) if (i * j + i + j) % 4 == 0]
    df = spark.createDataFrame([("d", i, t) for i, t in rows], "day string, id long, published_at long").withColumn("pinned", F.lit(False))
    got = D.walk(df, spark.createDataFrame(pairs, "e_id long, l_id long, score double"), "day").toPandas()
    assert {int(i): None if c != c or c is None else int(c) for i, c in zip(got["id"], got["canonical"].astype(object).where(got["canonical"].notna(), None))} == naive_walk(rows, pairs)


def test_election_never_chains_and_spares_pinned(spark):
    rows = [("d", 1, 1, True, 50, 0.6), ("d", 2, 2, False, 300, 0.9), ("d", 3, 3, False, 60, 0.6), ("d", 4, 4, False, 400, 0.9)]
    df = spark.createDataFrame(rows, "day string, id long, published_at long, pinned boolean, words int, score double")
    v = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.9)], "e_id long, l_id long, semantic double")
    got = {r["id"]: r["canonical"] for r in D.elect(df, v, "day").collect()}
    assert got == {1: None, 2: 1, 3: 4, 4: None}


def test_tfidf_pairs_equal_brute_force(spark):
    texts = ["new chip from acme ships", "acme ships new chip today", "weather is nice", "", None, "chip chip weather"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = D.tfidf(df, "id", "text")
    bags = {}
    for r in v.collect():
        bags.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = {(a, b): sum(w * bags[b].get(t, 0) for t, w in bags[a].items()) for a in bags for b in bags if a < b}
    got = {(r["a"], r["b"]): r["similarity"] for r in D.similar(v, 0.35).collect()}
    assert set(got) == {k for k, s in want.items() if s >= 0.35}


@pytest.mark.parametrize("word,want", [("regulations", "regul"), ("companies", "company"), ("testing", "test"), ("as", "as"), ("bus", "bus"), ("quickly", "quick")])
def test_stem(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(T.stem(F.col("w"))).first()[0] == want


def test_similarity_edges(spark):
    df = spark.createDataFrame([([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [tuple(round(x, 3) for x in r) for r in df.select(T.jaccard(F.col("a"), F.col("b")), T.overlap(F.col("a"), F.col("b")), T.coverage(F.col("a"), F.col("b"))).collect()] == [(0, 0, 0), (0.333, 0.5, 0.5)]


def test_business_day_edges(spark):
    df = spark.sql("select timestamp'2026-09-19 18:29:59.999999' a, timestamp'2026-09-19 18:30:00' b")
    assert [str(x) for x in df.select(T.coverage_date(F.col("a")), T.coverage_date(F.col("b"))).first()] == ["2026-09-19", "2026-09-20"]


def test_recency_bounds(spark):
    df = spark.sql("select timestamp'2026-09-20 12:00:00' n, timestamp'2026-09-20 01:00:00' a, timestamp'2026-09-18 01:00:00' b, cast(null as timestamp) c")
    assert list(df.select(*(R.recency(F.col(c), F.col("n")) for c in "abc")).first()) == [0.5, 0.0, 0.0]


def test_window_pairs_of_all_events(spark):
    ts = sorted((t.value // 1000, i) for t, i in spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id").toPandas().itertuples(index=False))
    gaps = [b[0] - a[0] for i, b in enumerate(ts) for a in ts[:i] if b[0] - a[0] <= 172_800_000_000]
    got = catalogue.queries()["q_window_pairs_48h"](spark, SF).first()
    assert got["pairs"] == len(gaps) and got["hours"] == pytest.approx(sum(gaps) / 3.6e9, rel=1e-9)


def test_window_totals_at_the_edges(spark):
    hour = 3_600_000_000
    times = [0, 0, 0, 1, 1, 999_999, 1_000_000, hour - 1, hour, hour + 1, 47 * hour, 48 * hour - 1, 48 * hour, 48 * hour, 48 * hour + 1, 49 * hour, 49 * hour + 1, 97 * hour, -1, -48 * hour, -47 * hour - 5, None]
    rows = [(t, None if i % 7 == 6 else i // 2) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "t long, k long").select(F.timestamp_micros("t").alias("ts"), "k")
    order = sorted((t, k is None, k or 0) for t, k in rows if t is not None)
    for hours in (1, 2, 48):
        gaps = [b[0] - a[0] for i, b in enumerate(order) for a in order[:i] if a < b and b[0] - a[0] <= hours * hour]
        assert tuple(map(int, J.window_totals(df, "ts", "k", hours).first())) == (len(gaps), sum(gaps))
    assert tuple(J.window_totals(df.filter("k = -1"), "ts", "k", 48).first()) == (0, None)


def test_window_pairs_of_a_crowded_hour_are_counted(spark, tmp_path):
    n = 300_000  # 4.5e10 pairs
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(1_700_000_000_000_000 + F.floor(F.col("id") / 3) * 1000).cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["q_window_pairs_48h"](spark, str(tmp_path)).first()
    m = n // 3  # times, a millisecond apart, three events each
    assert got["pairs"] == n * (n - 1) // 2 and got["hours"] == pytest.approx(9 * 1000 * (m**3 - m) // 6 / 3.6e9, rel=1e-12)


def test_tfidf_pairs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    bags = {i: Counter(re.findall("[a-z0-9_]{2,}", (x or "").lower())) for i, x in docs.itertuples(index=False)}
    df = Counter(w for b in bags.values() for w in b)
    n, unit = len(docs), {}
    for i, b in bags.items():
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in b.items() if df[w] <= 0.9 * n}
        unit[i] = {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    sims = {(a, b): sum(x * unit[b].get(w, 0) for w, x in unit[a].items()) for a in unit for b in unit if a < b}
    got = {(r["a"], r["b"]) for r in catalogue.queries()["q_tfidf_pairs"](spark, SF).collect()}
    assert got and {k for k, s in sims.items() if s > 0.350001} <= got <= {k for k, s in sims.items() if s > 0.349999}


def test_tfidf_pairs_are_never_rows_before_they_are_products(spark, monkeypatch):
    monkeypatch.setattr(D, "BAGS", 40)
    plan = D.similar_bags(D.tfidf_bags(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"), 0.35)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r["a"], r["b"]): r["similarity"] for r in catalogue.queries()["q_tfidf_pairs"](spark, SF).collect()}
    rows = plan.collect()  # 5 blocks, 15 cells
    assert len(rows) == len(whole) and {(r["a"], r["b"]): r["similarity"] for r in rows} == pytest.approx(whole, abs=1.1e-6)


def test_tfidf_bags_are_the_vectors(spark):
    texts = ["new chip from acme ships", "acme ships new chip today", "weather is nice", "", None, "chip chip weather", "chip new", "weather new"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rest = {}
    for r in D.tfidf(df, "id", "text").collect():
        rest.setdefault(r["id"], {})[r["term"]] = r["weight"]
    often = Counter(t for v in rest.values() for t in v)
    want = {i: sorted(w for t, w in v.items() if often[t] > 1) for i, v in rest.items()}
    got = {r["id"]: sorted(r["w"]) for r in D.tfidf_bags(df, "id", "text").collect()}
    assert set(got) == {i for i, v in want.items() if v} and all(got[i] == pytest.approx(want[i]) for i in got)


def test_overlaps_of_documents_and_benchmark(spark):
    bags = [{i: set(re.findall("[a-z0-9]+", (x or "").lower())) for i, x in spark.read.parquet(f"{SF}/{n}.parquet").select(k, "text").collect()} for n, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    want = {(a, b) for a, x in bags[0].items() for b, y in bags[1].items() if x and y and round(len(x & y) / min(len(x), len(y)), 6) >= 0.8}
    got = [(r["a"], r["b"]) for r in catalogue.queries()["q_overlap_coverage"](spark, SF).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_cosine_topk_asks_all(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {}
    for q in rows:
        if q["vec_id"] % 20 == 0:
            sims = [(-round(math.fsum(x * y for x, y in zip(q["embedding"], c["embedding"], strict=True)), 6), c["vec_id"]) for c in rows if c["vec_id"] != q["vec_id"]]
            want |= {(q["vec_id"], n + 1): -s for n, (s, _) in enumerate(sorted(x for x in sims if x[0] <= -0.1)[:10])}
    got = {(r["q"], r["rank"]): r["similarity"] for r in catalogue.queries()["q_cosine_topk"](spark, SF).collect()}
    assert want and got == pytest.approx(want, abs=2e-6)


def test_whole_texts_and_all_documents(spark, tmp_path):
    docs = [(i, f"A plain headline\n{'word ' * 800}{end}", lang, "src1") for i, (end, lang) in enumerate([("The company trains a large language model.", "de"), ("Nothing else.", "en")])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "word word word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["id"]: r["ai_relatedness"] for r in catalogue.queries()["q_rules_classifier"](spark, str(tmp_path)).collect()}
    assert got[0] != got[1]
    assert {r["q"] for r in catalogue.queries()["q_history_asof"](spark, str(tmp_path)).collect()} == {0, 1}


def test_day_stories_meet_by_content_and_titles_by_sequence(spark, tmp_path):
    body = " ".join(f"term{i}" for i in range(80))
    titles = {0: "Quiet harbour", 1: "Completely different heading", 2: "abcdefgh ijklmnop", 3: "abcdefgx ijklmnoy", 4: "Quiet harbour"}
    texts = {i: f"{t}\n{body if i < 2 else ' '.join(f'other{i}x{k}' for k in range(80))}" for i, t in titles.items()} | {4: f"Quiet harbour\n{body}"}
    spark.createDataFrame([(i, x, "en", f"src{i}") for i, x in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["e_id"], r["l_id"]): r for r in catalogue._verdicts(spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 1), (0, 4), (1, 4)} and 0.7 <= got[0, 1]["semantic"] < 1
    assert got[0, 4]["v"]["rule"] == "identical_source"
    walked = {r["id"]: r["canonical"] for r in catalogue.queries()["q_title_clusters"](spark, str(tmp_path)).collect()}
    assert walked[3] == 2
