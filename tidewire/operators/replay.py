"""What-if runs over stored days: nothing is written, old and new outcomes are compared."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedup as D


def transitions(old: DataFrame, new: DataFrame, key: str = "id", state: str = "state") -> DataFrame:
    """(old, new, n): how verdicts moved."""
    both = old.select(key, F.col(state).alias("old")).join(new.select(key, F.col(state).alias("new")), key, "full")
    return both.groupBy("old", "new").agg(F.count("*").alias("n"))


def pools(rows: DataFrame, by: str, repeats: DataFrame, published: DataFrame, **title) -> DataFrame:
    """(by, candidates, sufficient, distinct_titles, new): how many stories are left after each stage, from rows (by, id, title, published_at, candidate, sufficiency, pinned)."""
    chosen = rows.filter("candidate")
    enough = chosen.filter(~F.col("sufficiency").eqNullSafe("insufficient"))
    pairs = D.title_matches(enough, **title)
    day = enough.select("id", by)
    same_day = pairs.join(day.select(F.col("id").alias("e_id"), F.col(by).alias("d1")), "e_id").join(day.select(F.col("id").alias("l_id"), F.col(by).alias("d2")), "l_id").filter("d1 = d2")
    heads = D.walk(enough, same_day, by).filter("canonical is null").select(by, "id")
    left = heads.join(repeats.select("id"), "id", "left_anti").join(published.select("id"), "id", "left_anti")
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    out = count(chosen, "candidates")
    for df, name in ((enough, "sufficient"), (heads, "distinct_titles"), (left, "new")):
        out = out.join(count(df, name), by, "left")
    return out.fillna(0)


def compare_repeats(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(by, kind, n) of pairs that one or both of two methods call repeats. Each: by, id."""
    both = sparse.select("by", "id", F.lit(True).alias("s")).join(dense.select("by", "id", F.lit(True).alias("d")), ["by", "id"], "full")
    kind = F.when(F.col("s") & F.col("d"), "both").when(F.col("s"), "sparse only").otherwise("dense only")
    return both.groupBy("by", kind.alias("kind")).agg(F.count("*").alias("n"))


def learned(rows: DataFrame, days: list, tau: float = 0.55, c: float = 3.0) -> DataFrame:
    """Leave one day out: (id, day, label, said) from rows (id, day, text, label), by TF-IDF of words and pairs and a balanced logistic regression; unsure ones are for review.

    ``days`` is the list of evaluation days, a handful by nature: one model is fitted for each.
    """
    stages = [
        RegexTokenizer(inputCol="text", outputCol="w", pattern="\\W+", minTokenLength=2), NGram(n=2, inputCol="w", outputCol="p"), HashingTF(inputCol="w", outputCol="tw", numFeatures=1 << 16),
        HashingTF(inputCol="p", outputCol="tp", numFeatures=1 << 16), VectorAssembler(inputCols=["tw", "tp"], outputCol="t"), IDF(inputCol="t", outputCol="features", minDocFreq=2),
        LogisticRegression(labelCol="y", weightCol="weight", regParam=1 / (c * 1000), maxIter=50),
    ]
    rows, out = rows.withColumn("y", F.col("label").cast("double")), None
    for day in days:
        train, test = rows.filter(F.col("day") != F.lit(day)), rows.filter(F.col("day") == F.lit(day))
        sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
        total = sum(sizes.values())
        balance = F.when(F.col("y") == 1, total / (2 * max(1, sizes.get(1.0, 0)))).otherwise(total / (2 * max(1, sizes.get(0.0, 0))))
        p = vector_to_array("probability")[1]
        said = Pipeline(stages=stages).fit(train.withColumn("weight", balance)).transform(test).select("id", "day", "label", F.when(p >= tau, "cand").when(p <= 1 - tau, "rej").otherwise("rev").alias("said"))
        out = said if out is None else out.unionByName(said)
    return out
