"""The stages one by one, and all together."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_is_left(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
    assert first.count() >= sizes[0] >= sizes[1] == sizes[2]
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, tmp_path):
    base = " ".join(f"word{i} plain" for i in range(80))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", None, None), (4, None, "en", "a"), (5, "", "de", "b"), (6, "short", "de", "b"), (7, "first text of seven " * 30, "en", "a"),
        (7, "other words that share nothing with it " * 30, "en", "a"), (7, "first text of seven " * 30, "en", "a"), (None, base, None, None), (8, "x" * 30_000 + " " + base, "en", "a"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    want = {(0, base), (1, base), (4, ""), (5, ""), (6, "short"), (7, rows[6][1]), (7, rows[7][1])}  # 8 is a near copy of 1
    assert got == sorted(want)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
