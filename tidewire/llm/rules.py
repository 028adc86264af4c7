"""Quality rules whose cutoffs hold a bound on false rejection, with DataFrame functions only.

Fixed rules come first. The method then looks at a few measures of a text, each an integer from 0 to ``GRID``: share of symbols,
of repeated words, of lines that repeat, and length of words, long and short. For each stratum and measure it takes the
strictest cutoff for which documents labelled good are provably rejected too often with little chance:
the cutoffs of a measure are tried from lax to strict, and one passes while the exact binomial probability of so few
false rejections, were the true rate as high as the limit, is under ``error`` shared among all measures and strata
(Bonferroni); the first failure stops (so trying many cutoffs needs no further correction). The limit on false
rejection, ``limit``, is shared among the measures, so it holds for the verdict as a whole in each stratum, with probability
1 - ``error`` for all at once. A stratum with too few good documents gets no cutoff and loses nothing.

Counts by stratum, measure and value are added up before any shuffle, so their number has a bound for any number of
documents: strata x measures x (GRID + 1). Strata are languages, null being one.

The binomial tail is summed from its largest term down, by ratios of neighbours, over ``TERMS`` terms, and a geometric
bound on what remains is added, so that it is never too small.

Defined results: a null or empty text has no words; it fails the base. Rows that repeat are answered each; a label that
repeats counts once (the smallest); a document labelled good counts once for each of its rows. A null doc_id is carried along and never
learned from. Empty tables: no rows, or no cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, Tables

GRID, TERMS = 1000, 2000
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def windows(words: Column, width: int = 3) -> Column:
    """A hash of each window of ``width`` words, in order."""
    at = F.sequence(F.lit(1), F.size(words) - (width - 1))
    return F.when(F.size(words) >= width, F.transform(at, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column, width: int = 3) -> Column:
    """How many words stand in a window whose hash occurs twice or more: sort (hash, place), keep neighbours that agree, and add up what each place adds past the one before."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, k, j: F.coalesce(F.get(a, k)["h"] == F.get(a, j)["h"], F.lit(False))
    marked = lambda a: F.transform(a, lambda x, k: F.when(same(a, k, k - 1) | same(a, k, k + 1), x["i"]))
    places = lambda a: F.sort_array(F.array_compact(marked(a)))
    zero = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    add = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"))
    count = F.transform(F.array(order), lambda a: F.aggregate(places(a), zero, add, lambda acc: acc["n"]))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.get(count, F.lit(0)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the base's verdict, of each row of ``docs`` (doc_id, text, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("__text")).withColumn("__words", words_of(F.col("__text")))
    rows = rows.withColumn("__windows", windows(F.col("__words")))
    lines = F.filter(F.split(F.col("__text"), "\n", -1), lambda line: F.regexp_like(line, F.lit(WORD)))
    rows = rows.select(
        "doc_id", "lang", "__text", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        repeated_words(F.col("__windows")).cast("long").alias("n_repeat_words"), lines.alias("__lines"),
    )
    symbols = F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))
    rows = rows.select("doc_id", "lang", "n_words", "word_chars", symbols.cast("long").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", F.size("__lines").alias("__n_lines"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _grid(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.when(whole > 0, F.least(F.lit(GRID), F.floor(GRID * part / (whole * scale)))).otherwise(F.lit(0)).cast("int")


def measures() -> dict[str, Column]:
    """The higher, the worse."""
    return {
        "symbols": _grid(F.col("n_symbols"), F.col("n_words"), 2.0),
        "repeats": _grid(F.col("n_repeat_words"), F.col("n_words")),
        "lines": _grid(F.col("n_dup_lines"), F.col("__n_lines")),
        "long": _grid(F.col("word_chars"), F.col("n_words"), 20.0),
        "short": F.lit(GRID) - _grid(F.col("word_chars"), F.col("n_words"), 20.0),
    }


def log_factorial(x: Column) -> Column:
    """log x!, by Stirling's series of x + 8 shifted back; right to about 1e-12."""
    y = x.cast("double") + 9
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    shift = F.lit(0.0)
    for k in range(1, 9):
        shift = shift + F.log(x.cast("double") + k)
    return series - shift


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of X binomial (n, rate), or a little more; 1 where k is at or past the mean."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    odds = (1 - rate) / rate
    step = lambda acc, j: F.struct((acc["term"] * odds * (k - j) / (n - k + j + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    ratio = F.least(F.lit(0.999999), odds * F.greatest(F.lit(0), k - TERMS) / (n - k + TERMS))
    total = F.aggregate(F.sequence(F.lit(0), F.least(k, F.lit(TERMS - 1)).cast("int")), zero, step, lambda acc: acc["sum"] + acc["term"] / (1 - ratio))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def cutoffs(tables: Tables, rows: DataFrame, labels: DataFrame, *, limit: float, error: float) -> DataFrame:
    """(lang, one column of the smallest rejected value for each measure) from rows of ``measured`` that passed the base and are labelled good."""
    names = list(measures())
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    held = rows.filter("not base_failed and doc_id is not null").join(good, "doc_id", "left_semi").select("lang", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in measures().items()))).alias("x"))
    counts = held.groupBy("lang", "x.measure", "x.value").agg(F.count("*").alias("c"))
    group = Window.partitionBy("lang", "measure")
    worse = F.sum("c").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    strata = counts.groupBy(F.col("lang").alias("__lang")).agg(F.lit(1).alias("one")).withColumn("strata", F.sum("one").over(Window.partitionBy()))  # a row for each language
    counts = counts.withColumn("n", F.sum("c").over(group)).withColumn("k", worse).join(strata, F.col("lang").eqNullSafe(F.col("__lang")))
    counts = tables.keep(counts.select("lang", "measure", "value", "n", "k", "strata"), "counts")
    # rejecting ``value`` and above rejects k of n; the values between two seen ones reject the same documents
    tail = binomial_tail(F.col("k"), F.col("n"), limit / len(names))
    none = binomial_tail(F.lit(0).cast("long"), F.col("n"), limit / len(names))
    share = error / len(names) / F.col("strata")
    counts = tables.keep(counts.withColumn("passes", tail <= share).withColumn("room", none <= share), "tails")
    counts = counts.withColumn("top", F.when(F.col("room"), F.max("value").over(group) + 1))
    best = counts.groupBy("lang", "measure").agg(F.min(F.when(F.col("passes"), F.col("value"))).alias("cut"), F.max("top").alias("top"))
    best = best.select("lang", "measure", F.coalesce("cut", "top").alias("cut"))
    return best.groupBy("lang").agg(*(F.max(F.when(F.col("measure") == m, F.col("cut"))).alias(f"__{m}") for m in names))


def judged(docs: DataFrame, labels: DataFrame, *, limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of ``docs``."""
    tables = Tables(docs.sparkSession, "rules")
    rows = tables.keep(measured(docs), "measured")
    cuts = tables.keep(cutoffs(tables, rows, labels, limit=limit, error=error), "cutoffs")
    joined = rows.join(cuts.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    bad = F.lit(False)
    for m, v in measures().items():
        bad = bad | F.coalesce(v >= F.col(f"__{m}"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))
