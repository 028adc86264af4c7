"""Features of stories, relevance of sources, grades of scripts and checks, on literal inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import patterns as P
from tidewire.functions import text as T
from tidewire.operators import classify as C
from tidewire.operators import dedup as D
from tidewire.operators import features as FE
from tidewire.operators import quality as QA
from tidewire.operators import relevance as RE
from tidewire.plans import api

BODY = "OpenAI launched Dots, an assistant for phones, on Monday. The company said Dots runs on GPT-6.1 and costs $20 a month. Sam Altman showed it in Paris. " + "It answers questions and books tables for people who ask it to do so. " * 10
SCHEMA = "id long, title string, raw_content string, raw_summary string, fetch_status string, url string, content_hash string, source_name string"


@pytest.fixture(scope="module")
def bundle(spark):
    rows = [
        (1, "OpenAI launches Dots assistant", BODY, None, "success", "https://a.example/1", "h1", "The Verge"), (2, "OpenAI introduces its Dots assistant", BODY + " More.", None, None, "https://b.example/2", "h2", "Wired"),
        (3, "OpenAI cuts price of Dots to $15", "OpenAI now sells Dots at $15 a month. " + BODY, None, None, "https://c.example/3", "h3", "Wired"), (4, "Google unveils Gemini 4 model", "Google presented Gemini 4 in Berlin. " * 30, None, None, None, "h4", "Wired"),
        (5, "Dots assistant", None, None, "fetch_error", None, None, "Hacker News"), (6, None, None, None, None, None, None, None), (7, "OpenAI launches Dots assistant", BODY, None, "success", "https://a.example/1", "h1", "Copy"),
    ]
    return FE.bundle(spark.createDataFrame(rows, SCHEMA)).cache()


def test_entities(bundle):
    got = {r["id"]: r for r in bundle.collect()}
    assert set(got[1]["title_entities"]) == {"openai", "dots"} and got[1]["specific"] == ["dots"] and got[1]["title_companies"] == ["openai"]
    assert {"gpt-6.1", "altman", "paris", "dots"} <= set(got[1]["lead_entities"]) and "monday" not in got[1]["lead_entities"]
    assert (got[1]["quality"], got[5]["quality"], got[6]["quality"]) == ("full", "title_only", "title_only")
    assert got[3]["title_numbers"] == ["15"] and got[3]["types"]["types"][0] == "pricing" and got[4]["specific"] == ["gemini"]


def test_pairs_by_real_features(spark, bundle):
    pairs = spark.createDataFrame([(2, 1, 0.95, 0.9), (3, 1, 0.9, 0.7), (4, 1, 0.8, 0.2), (7, 1, 1.0, 1.0), (5, 1, 0.75, 0.5), (4, 2, 0.3, 0.1)], "new long, old long, semantic double, title_sim double")
    got = {(r["new"], r["old"]): r for r in FE.same_day(FE.judged(pairs.withColumn("tfidf", F.lit(0.0)), bundle)).collect()}
    assert got[2, 1]["rule"] == "same_launch" and got[2, 1]["subject"] == "shared" and got[2, 1]["facts"]["numbers"] == []
    assert got[3, 1]["decision"] == "new_development" and got[3, 1]["facts"]["numbers"] == ["15"]
    assert got[4, 1]["rule"] == "different_subject" and got[7, 1]["rule"] == "identical_source" and not got[4, 2]["related"]
    assert got[5, 1]["rule"] == "bare_headline_report" and "headline number 15 not in earlier article" in got[3, 1]["new_facts"]


def test_detection_prefers_duplicates_and_what_is_visible(spark, bundle):
    stories = bundle.filter("id in (2, 7)").withColumn("as_of", F.lit("2026-10-02").cast("date"))
    corpus = bundle.filter("id in (1, 3, 4)").withColumn("published", F.when(F.col("id") == 3, "2026-10-05").otherwise("2026-10-01").cast("date"))
    similar = spark.createDataFrame([(2, 1, 0.95, 0.9), (2, 3, 0.99, 0.9)], "id long, c long, semantic double, title_sim double")
    got = {r["id"]: r for r in FE.detect(stories, corpus, similar).collect()}
    assert (got[2]["matched_id"], got[2]["rule"]) == (1, "same_launch") and (got[7]["matched_id"], got[7]["rule"]) == (1, "identical_source")


def test_dense_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    side = lambda k: spark.createDataFrame([(i, "a" if i % 3 else "b", x.tolist(), x.tolist()) for i, x in enumerate(v)], f"{k} long, g string, {k}_body array<double>, {k}_head array<double>")
    want = {(i, j) for i in range(40) for j in range(40) if i != j and round(float(v[i] @ v[j]), 6) >= 0.3}
    assert {(r["id"], r["c"]) for r in D.dense_pairs(side("id"), side("c"), 0.3).collect()} == want
    assert {(r["id"], r["c"]) for r in D.dense_pairs(side("id"), side("c"), 0.3, "g").collect()} == {(i, j) for i, j in want if (i % 3 == 0) == (j % 3 == 0)}


def test_dense_best_has_the_best_of_all(spark, monkeypatch):
    for k, v in (("WIDE", 7), ("ROUND", 20), ("BLOCK", 9)):
        monkeypatch.setattr(D, k, v)
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=(60, 6))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, i % 9, [f"n{i % 11}"] if i % 2 else [], [i - 5] if i % 7 == 0 else None, x.tolist(), x.tolist()) for i, x in enumerate(v)]
    side = lambda k: spark.createDataFrame(rows, f"{k} long, {k}_day int, {k}_names array<string>, {k}_own array<long>, {k}_body array<float>, {k}_head array<float>")
    weight = lambda a, b, s: 2.0 if rows[b][0] in (rows[a][3] or ()) else s + bool(set(rows[a][2]) & set(rows[b][2]))
    sims = {(a, b): round(float(v[a].astype(float) @ v[b].astype(float)), 6) for a in range(60) for b in range(60) if rows[b][1] < rows[a][1]}
    best = lambda pairs, a: sorted(((-weight(a, b, s), b) for (x, b), s in pairs.items() if x == a))[:3]
    found = D.dense_best(side("id"), side("c").drop("c_own"), 0.5, 3).collect()
    got = {(r["id"], r["c"]): r["semantic"] for r in found}
    want = {k: s for k, s in sims.items() if s >= 0.5}
    assert len(found) == len(got) < len(want) and all(abs(sims[k] - s) < 2e-6 for k, s in got.items())
    assert all([b for _, b in best(got, a)] == [b for _, b in best(want, a)] for a in range(60))


@pytest.mark.parametrize("title", ["OpenAI scraps chatbot subscription", "Google revamps Gemini app", "Anthropic triples Claude quota", "Meta sacks AI lead"])
def test_all_verbs_count(spark, title):
    assert spark.createDataFrame([(title,)], "t string").select(C.relevance_rules(F.col("t"), F.lit(None).cast("string")).alias("r")).first()["r"]["disposition"] == "candidate"


@pytest.mark.parametrize("stem,forms", [("carry", {"carrys", "carrying", "carries", "carried"}), ("use", {"uses", "used", "useing", "using"}), ("push", {"pushs", "pushes", "pushed", "pushing"}), ("cut", {"cuts", "cuted", "cuting", "cutted", "cutting"})])
def test_inflections(stem, forms):
    assert P.inflections(stem) == forms


def test_numbers_and_units(spark):
    df = spark.createDataFrame([("Up 5% to $1,200 million, a 3x rise in 2024", "Up 7 percent to $1,200 million")], "a string, b string")
    r = df.select(T.numbers_by_unit(F.col("a")).alias("u"), T.numeric_conflict(F.col("a"), F.col("b")).alias("c"), T.numeric_conflict(F.col("b"), F.col("b")).alias("same"), T.main_figure(F.col("a")).alias("f")).first()
    assert r["u"] == {"pct": ["5"], "usd": ["1200million"], "mult": ["3x"], "plain": ["2024"]} and r["c"] and not r["same"] and (r["f"]["stat"], r["f"]["unit"]) == ("$1,200 million", "usd")


@pytest.mark.parametrize(
    "headline,source,status",
    [
        ("Alphabet sued over Gemini training data", "A lawsuit against Google says that Gemini was trained on data of publishers without leave.", "relevant"),
        ("OpenAI releases Atlas-3 browser", "The Atlas-2 browser by OpenAI came out last year with many functions for all users.", "weak_relevance"),
        ("Nvidia ships Blackwell racks to Microsoft", "A recipe for bread needs flour and water and some salt and a hot oven.", "irrelevant"),
        ("A new way", "Any text that is long enough to be compared with something else.", "unknown"), ("OpenAI releases Atlas-3 browser", "Too short.", "unknown"),
    ],
)
def test_relevance_of_sources(headline, source, status):
    assert RE.assess(headline, source)[0] == status


def test_grades():
    source = "OpenAI launched Dots in Paris on Monday for $20 a month. The tool books tables for 3 million people."
    good = "OpenAI shows a phone assistant. OpenAI launched Dots in Paris on Monday for $20 a month."
    status, score, parts, gates = RE.grade("OpenAI shows a phone assistant", good, [source], "sufficient", "relevant")
    assert (status, gates) == ("pass", []) and score >= 0.8 and parts["grounding"] == 1.0
    assert "unsupported claim" in RE.grade("OpenAI shows a phone assistant", good.replace("$20", "$35"), [source], "sufficient")[3]
    assert RE.grade("OpenAI shows a phone assistant", "", [source], "sufficient")[0] == "fail"
    assert RE.grade("OpenAI shows a phone assistant.", "OpenAI shows a phone assistant.", [source], "sufficient")[0] == "review"


def test_checks_of_episodes_and_scenes(spark):
    rows = [(1, "ai_candidate", "verified", "https://a.example", 2, 9.0, "pass", 240.0)] * 25 + [(2, "not_ai", "verified", None, 0, None, None, None)]
    df = spark.createDataFrame(rows, "episode_id long, ai_relevance string, verification_status string, canonical_url string, cues int, audio_seconds double, script_quality_status string, video_seconds double")
    got = {(r["episode_id"], r["check_name"]): r["passed"] for r in QA.episode_checks(df).collect()}
    assert all(got[1, c] for e, c in got if e == 1)
    assert [got[2, c] for c in ("story_count", "ai_only", "verification", "source_links", "captions", "audio", "script_quality", "video", "duration")] == [False, False, True, False, False, False, None, False, None]
    scenes = [(1, 1, "hero", 0.0, 4.0, "A 5", "A 5", 10.0, 3.0, 8), (1, 2, "statistic", 4.0, 10.0, "B 7", "no figure", 10.0, 7.5, 8)]
    df = spark.createDataFrame(scenes, "story_id long, scene int, kind string, start double, end double, text string, source_text string, audio_seconds double, longest_cue double, cue_words int")
    got = {r["check_name"]: r for r in QA.scene_checks(df).collect()}
    assert not got["figures_in_source"]["passed"] and all(r["passed"] for c, r in got.items() if c != "figures_in_source") and got["cue_duration"]["detail"].startswith("near")


def test_small_routes(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    rows = spark.range(3).select("id", F.when(F.col("id") > 0, t("2026-01-02 00:00:00")).alias("video_produced_at"), F.when(F.col("id") == 1, t("2026-01-03 00:00:00")).alias("qa_run_at"), F.lit(None).cast("timestamp").alias("content_changed_at"))
    assert [r["stale"] for r in api.qa_is_stale(rows).orderBy("id").collect()] == [False, False, True]
    named = spark.createDataFrame([("OpenAI and Google", "x"), ("OpenAI ships", "x"), ("Plain", "Google Blog")], "t string, s string")
    assert [r[0] for r in named.select(api.named_company(F.col("t"), F.col("s"), {"OpenAI": "OpenAI", "Google": "Google"}, {"Google": "^Google"})).collect()] == [None, "OpenAI", "Google"]
    text = spark.createDataFrame([('He said "no." Then (he left!) And so',)], "t string").select(T.closed_sentences(F.col("t"))).first()[0]
    assert text == ['He said "no."', "Then (he left!)", "And so"]
