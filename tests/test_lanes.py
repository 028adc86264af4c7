"""Three-lane evaluation, styled captions, staleness, labels and reports on literal inputs."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewire.operators import evaluate as E
from tidewire.operators import storyboard as S
from tidewire.sources import reports


def lanes(spark):
    rows = [("cand", "cand"), ("cand", "rej"), ("rev", "rev"), ("rej", "cand"), ("rej", "rev"), ("rej", "rej")]
    return spark.createDataFrame(rows, "t string, s string")


def test_headline(spark):
    got = E.headline(lanes(spark), F.col("t"), F.col("s")).first().asDict()
    assert (got["n"], got["hard_fn_cand"], got["hard_fn_cand_or_rev"], got["auto_fp"], got["rej_to_review"]) == (6, 1, 1, 1, 1)
    assert (got["cand_recall_auto"], got["cand_recall_surfaced"], got["cand_precision"], got["surfaced_precision"], got["exact_acc"]) == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert (got["nonrej_recall_surfaced"], got["review_load"]) == (0.666667, 0.333333)


def test_headline_without_rows(spark):
    got = E.headline(lanes(spark).filter("false"), F.col("t"), F.col("s")).first()
    assert got["n"] == 0 and got["cand_precision"] is None and got["exact_acc"] is None


def test_labelled_slices(spark):
    rows = spark.createDataFrame([(["thin", "implicit"], "tut", "core", "l", "cand", "rej"), ([], "deal", "adj", "l", "rej", "cand"), ([], "dev", "core", "h", "cand", "rev")], "tags array<string>, ctype string, ai string, aud string, t string, s string")
    named = E.labelled_slices()
    assert len(named) == 15
    got = {r["slice"]: (r["n"], r["exp_cand"], r["fn"], r["fp"], r["rev"]) for r in E.lane_slices(rows, named, F.col("t"), F.col("s")).collect()}
    assert got == {"thin": (1, 1, 1, 0, 0), "implicit": (1, 1, 1, 0, 0), "tutorials": (1, 1, 1, 0, 0), "generic_ai": (1, 1, 1, 0, 0), "deals": (1, 0, 0, 1, 0)}


def test_gate_sweep_equals_counting(spark):
    rows = [("cand", "cand", "cand"), ("cand", "rev", "rej"), ("rev", "rev", "rev"), ("rej", "cand", "rev"), ("rej", "rej", "rej")]
    got = {(r["kc"], r["ks"]): (r["silent"], r["rej_in_cand"], r["cand_lane"], r["review_lane"]) for r in E.gate_sweep(spark.createDataFrame(rows, "t string, a string, b string"), [F.col("a"), F.col("b")], F.col("t")).collect()}
    for kc in (1, 2):
        for ks in (1, 2):
            lane = [(t, "cand" if [a, b].count("cand") >= kc else "rev" if 2 - [a, b].count("rej") >= ks else "rej") for t, a, b in rows]
            assert got[kc, ks] == (sum(t != "rej" and x == "rej" for t, x in lane), lane.count(("rej", "cand")), sum(x == "cand" for _, x in lane), sum(x == "rev" for _, x in lane))


def test_styled_events(spark):
    cues = [(1, 0, ["a", "b"], 0.0, 2.0, "Plain"), (1, 1, ["c"], 1.5, 3.0, "Plain"), (1, 2, ["inside"], 2.0, 2.5, "Plain"), (1, 3, ["d"], 3661.25, 3662.0, "Big")]
    got = [r["event"] for r in S.styled_events(spark.createDataFrame(cues, "s int, n int, lines array<string>, start double, end double, style string"), "s", "n").orderBy("n").collect()]
    assert got == ["Dialogue: 1,0:00:00.00,0:00:02.00,Plain,,0,0,0,,{\\fad(80,0)}a\\Nb", "Dialogue: 1,0:00:02.00,0:00:03.00,Plain,,0,0,0,,{\\fad(0,0)}c", "Dialogue: 1,1:01:01.25,1:01:02.00,Big,,0,0,0,,{\\fad(80,80)}d"]


def test_staleness(spark):
    a, b = datetime(2026, 1, 1), datetime(2026, 1, 2)
    rows = spark.createDataFrame([(1, None, None, None), (2, a, None, None), (3, a, b, None), (4, b, a, None), (5, a, a, b), (6, a, b, b)], "id int, produced timestamp, checked timestamp, changed timestamp")
    got = {r["id"]: r["x"] for r in rows.select("id", S.qa_stale(F.col("produced"), F.col("checked"), F.col("changed")).alias("x")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False}
    valid = {r["id"]: r["x"] for r in rows.select("id", S.artefact_valid(F.col("produced"), F.col("changed")).alias("x")).collect()}
    assert valid == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False}


def test_post_labels(spark):
    rows = spark.createDataFrame([("03/10/2026", "9:00 AM"), ("3/10/2026", "9:00 AM"), ("03/10/2026", "13:00 PM"), (None, "9:00 AM")], "d string, t string")
    assert [r["x"] for r in rows.select(S.valid_labels(F.col("d"), F.col("t")).alias("x")).collect()] == [True, False, False, False]


def test_labels_are_read_and_joined(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('id,tech,ai,ctype,aud,exp,conf,tags,note\n1,y,core,dev,h,cand,h,"thin,implicit,thin",x\n2,y,none,tut,l,rej,m,,"a, b"\n')
    items = spark.createDataFrame([(1, "T", "s"), (2, "U", None), (3, "V", "w")], "id long, title string, summary string")
    got = {r["id"]: (r["tags"], r["exp"], r["text"]) for r in reports.labelled(items, reports.labels(spark, str(tmp_path / "labels.csv"))).collect()}
    assert got == {1: (["thin", "implicit"], "cand", "T. s"), 2: ([], "rej", "U. ")}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", None)], "name string, n int")
    assert [r["value"] for r in reports.markdown(rows).collect()] == ["| name | n |", "| - | - |", "| a |  |", "| b | 2 |"]
    reports.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "json")).count() == 2 and spark.read.text(str(tmp_path / "r" / "markdown")).count() == 4


def test_artefacts(spark):
    scenes = spark.createDataFrame([(7, 1, "key_fact"), (7, 0, "hero")], "story int, nth int, kind string")
    got = reports.artefacts(scenes, "story", "nth").collect()
    assert [(r["story"], json.loads(r["json"])) for r in got] == [(7, {"story": 7, "scenes": [{"nth": 0, "kind": "hero"}, {"nth": 1, "kind": "key_fact"}]})]
