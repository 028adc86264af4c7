"""Metrics of classifiers against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, said: str) -> DataFrame:
    return rows.groupBy(truth, said).agg(F.count("*").alias("n"))


def metrics(rows: DataFrame, by: list[str], truth: Column, said: Column) -> DataFrame:
    """Precision, recall and F1 in one pass; null where a denominator is 0."""
    both, t, s = F.count_if(truth & said), F.count_if(truth), F.count_if(said)
    part = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return rows.groupBy(*by).agg(part(both, s).alias("precision"), part(both, t).alias("recall"), part(2.0 * both, s + t).alias("f1"))


def slices(rows: DataFrame, named: dict[str, Column], truth: Column, said: Column) -> DataFrame:
    """Errors in each named slice; a row counts in all slices it is in."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))
    each = rows.select(F.explode(names).alias("slice"), truth.alias("__t"), said.alias("__s"))
    return each.groupBy("slice").agg(F.count_if(F.col("__t") & ~F.col("__s")).alias("missed"), F.count_if(F.col("__s") & ~F.col("__t")).alias("wrong"), F.count("*").alias("n"))


def vote_sweep(rows: DataFrame, votes: list[Column], truth: Column) -> DataFrame:
    """For each k: how many rows at least k voters accept, and how many of those are right. Rows are added up by votes first."""
    count = sum((v.cast("int") for v in votes[1:]), votes[0].cast("int"))
    sums = rows.select(count.alias("votes"), truth.alias("t")).groupBy("votes").agg(F.count("*").alias("n"), F.count_if("t").alias("r"))
    each = sums.select("n", "r", F.explode(F.filter(F.sequence(F.lit(1), F.lit(len(votes))), lambda k: k <= F.col("votes"))).alias("k"))
    return each.groupBy("k").agg(F.sum("n").alias("accepted"), F.sum("r").alias("right_ones"))


def gate(candidate: Column, review: Column, least_candidate: int | Column, least_review: int | Column) -> Column:
    return F.when(candidate >= least_candidate, "cand").when(review >= least_review, "rev").otherwise("rej")


# ---- three lanes: candidates (cand), human review (rev), rejects (rej) ----

#: The slices of the labelled set, by tag, by content type and by what the labels say of AI and audience.
TAG_SLICES = ("name_gap", "implicit", "robot_emerging", "oss_project", "chips_infra", "policy_safety", "ai_nonnews", "nonai_tech", "thin")
TYPE_SLICES = {"tutorials": ("tut",), "deals": ("deal", "event", "spons"), "opinions": ("opin",), "reviews": ("rev",), "roundups": ("round", "bg")}


def labelled_slices() -> dict[str, Column]:
    """Predicates over labelled rows (tags, ctype, ai, aud)."""
    tagged = {t: F.array_contains("tags", t) for t in TAG_SLICES}
    typed = {n: F.col("ctype").isin(*kinds) for n, kinds in TYPE_SLICES.items()}
    return tagged | typed | {"generic_ai": (F.col("ai") == "core") & (F.col("aud") == "l")}


def _share(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), 6)


def headline(rows: DataFrame, truth: Column, said: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The twelve figures of a classifier with a review lane, in one pass: what it finds, what it loses silently, what it lets in and what it sends to people. Shares of nothing are null; rows without a truth or an answer count in ``n`` only."""
    is_ = lambda c, *lanes: c.isin(*lanes)
    of = lambda *p: F.count_if(p[0] if len(p) == 1 else p[0] & p[1])
    c, open_, r = is_(truth, "cand"), is_(truth, "cand", "rev"), is_(truth, "rej")
    to_c, shown, to_rev, to_rej = is_(said, "cand"), is_(said, "cand", "rev"), is_(said, "rev"), is_(said, "rej")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), _share(of(c, to_c), of(c)).alias("cand_recall_auto"), _share(of(c, shown), of(c)).alias("cand_recall_surfaced"), _share(of(open_, shown), of(open_)).alias("nonrej_recall_surfaced"),
        of(c, to_rej).alias("hard_fn_cand"), of(open_, to_rej).alias("hard_fn_cand_or_rev"), of(r, to_c).alias("auto_fp"), of(r, to_rev).alias("rej_to_review"), _share(of(to_rev), F.count("*")).alias("review_load"),
        _share(of(c, to_c), of(to_c)).alias("cand_precision"), _share(of(open_, shown), of(shown)).alias("surfaced_precision"), _share(of(truth == said), F.count("*")).alias("exact_acc"),
    )


def lane_slices(rows: DataFrame, named: dict[str, Column], truth: Column, said: Column) -> DataFrame:
    """Of each named slice: its size, the lanes expected in it, what was lost (``fn``), what got in (``fp``) and what went to review. A row counts in all slices it is in."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))
    each = rows.select(F.explode(names).alias("slice"), truth.alias("t"), said.alias("s"))
    expected = [F.count_if(F.col("t") == lane).alias(f"exp_{lane}") for lane in ("cand", "rev", "rej")]
    lost, let_in = F.col("t").isin("cand", "rev") & (F.col("s") == "rej"), (F.col("t") == "rej") & (F.col("s") == "cand")
    return each.groupBy("slice").agg(F.count("*").alias("n"), *expected, F.count_if(lost).alias("fn"), F.count_if(let_in).alias("fp"), F.count_if(F.col("s") == "rev").alias("rev"))


def gate_sweep(rows: DataFrame, votes: list[Column], truth: Column) -> DataFrame:
    """For each pair of thresholds (kc, ks) over voters' lanes: a row is a candidate from kc votes for cand, is reviewed from ks votes for cand or rev, and else rejected. Rows are added up by their votes first, so the grid meets a table of (voters + 1)^2 x 3 rows."""
    tally = lambda *lanes: sum((v.isin(*lanes).cast("int") for v in votes[1:]), votes[0].isin(*lanes).cast("int"))
    sums = rows.select(tally("cand").alias("c"), tally("cand", "rev").alias("s"), truth.alias("t")).groupBy("c", "s", "t").agg(F.count("*").alias("n"))
    steps = F.sequence(F.lit(1), F.lit(len(votes)))
    each = sums.withColumn("kc", F.explode(steps)).withColumn("ks", F.explode(steps)).withColumn("lane", gate(F.col("c"), F.col("s"), F.col("kc"), F.col("ks")))
    total = lambda p: F.sum(F.when(p, F.col("n")).otherwise(0))
    return each.groupBy("kc", "ks").agg(
        total(F.col("t").isin("cand", "rev") & (F.col("lane") == "rej")).alias("silent"), total((F.col("t") == "rej") & (F.col("lane") == "cand")).alias("rej_in_cand"),
        total(F.col("lane") == "cand").alias("cand_lane"), total(F.col("lane") == "rev").alias("review_lane"),
    )
