"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor
directory, with DataFrame functions only.

Templates are a small fixed table, so their weights are literals of the plan and a text is compared without a shuffle. In
a text the sentences that mention a licence at all are compared one by one; a licence file is compared as a whole as well.
What a licence file says holds for its directory, and for files further down that state none and have no nearer one.
Ancestors are listed for each distinct directory, not for each file, and joined by path.

Defined results: null and empty texts, and texts that mention no licence, state none (licence null, score 0). Ties: the
template first in order; of a directory's licence files the best score, then the first licence by name. A null path has no
directory and inherits nothing. Rows that repeat are answered each. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: SPDX names and the usual wording of notices.
TEMPLATES = (
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("BSD-2-Clause", "released under the bsd 2 clause simplified license"),
    ("BSD-3-Clause", "released under the bsd 3 clause new license redistribution and use in source and binary forms"),
    ("CC-BY-4.0", "licensed under creative commons attribution cc by 4.0 license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0 creative commons attribution noncommercial"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0 creative commons attribution sharealike"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("ISC", "released under the isc license permission to use copy modify and distribute"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("MIT", "released under the mit license"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("Unlicense", "free and unencumbered software released into the public domain unlicense"),
)
MENTIONS = ("licen", "copyright", "spdx", "public domain", "cc0")
TERM = "[a-z0-9]+(?:\\.[0-9]+)*"
LICENCE_FILE = "(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"


def weights(templates=TEMPLATES) -> tuple[dict[str, float], dict[str, list[float]], float]:
    """(inverse document frequency of each term, its unit-length weight in each template, frequency weight of an unknown term)."""
    bags = [Counter(re.findall(TERM, text)) for _, text in templates]
    n = len(bags)
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    norms = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in bag.items())) for bag in bags]
    return idf, {t: [bag[t] * idf[t] / norm for bag, norm in zip(bags, norms, strict=True)] for t in sorted(idf)}, math.log(1 + n) + 1


def _best(terms: Column, templates=TEMPLATES) -> Column:
    """struct(score, nth): the largest cosine of a bag of terms to a template, and which. Linear in the terms but for one sort."""
    idf, rows, unknown = weights(templates)
    table = F.create_map(*(x for t, row in rows.items() for x in (F.lit(t), F.array(*(F.lit(v * idf[t]) for v in row)))))
    known = F.create_map(*(x for t, v in sorted(idf.items()) for x in (F.lit(t), F.lit(v * v))))
    # the square of a bag's length: an n-th occurrence of a term adds (2 n - 1) of its squared weight
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("square"))

    def add(acc: Column, t: Column) -> Column:
        n = F.when(acc["last"] == t, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), n.alias("n"), (acc["square"] + (2 * n - 1) * F.coalesce(F.try_element_at(known, t), F.lit(unknown * unknown))).alias("square"))

    square = F.aggregate(F.array_sort(terms), zero, add, lambda acc: acc["square"])
    zeros = F.array(*(F.lit(0.0) for _ in templates))
    dots = F.aggregate(F.filter(terms, lambda t: F.map_contains_key(known, t)), zeros, lambda acc, t: F.zip_with(acc, F.try_element_at(table, t), lambda a, w: a + w))
    scores = F.transform(dots, lambda d, i: F.struct(F.when(square > 0, d / F.sqrt(square)).otherwise(F.lit(0.0)).alias("score"), (-i).alias("nth")))
    return F.array_max(scores)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def stated(files: DataFrame, *, cutoff: float = 0.6) -> DataFrame:
    """``files`` (path, text, others) with ``licence`` and ``score``: what a file states itself, and ``edge``: whether its first or last sentence does."""
    names = F.array(*(F.lit(name) for name, _ in TEMPLATES))
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    mentions = F.lit(False)
    for m in MENTIONS:
        mentions = mentions | low.contains(m)
    mention = lambda s: F.exists(F.array(*map(F.lit, MENTIONS)), lambda m: F.contains(F.lower(s), m))
    sentences = F.transform(F.split("text", "[.!?]\\s|\n", -1), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    last = F.size(F.split("text", "[.!?]\\s|\n", -1)) - 1
    found = F.when(mentions, F.filter(sentences, lambda x: mention(x["s"])))
    rows = files.withColumn("__found", found).withColumn("__last", F.when(F.col("__found").isNotNull(), last))
    each = F.transform("__found", lambda x: F.struct(_best(terms_of(x["s"])).alias("best"), (-x["i"]).alias("i")))
    whole = F.when(F.regexp_like(F.col("path"), F.lit(LICENCE_FILE)) & F.col("__found").isNotNull(), _best(terms_of(F.col("text"))))
    rows = rows.withColumn("__each", F.array_max(each)).withColumn("__whole", whole)
    rows = rows.withColumn("__best", F.greatest(F.col("__each.best"), F.col("__whole")))
    enough = F.coalesce(F.col("__best.score") >= cutoff, F.lit(False))
    rows = rows.withColumn("licence", F.when(enough, F.get(names, -F.col("__best.nth"))))
    rows = rows.withColumn("score", F.round(F.coalesce(F.col("__best.score"), F.lit(0.0)), 6)).withColumn("edge", enough & F.coalesce((F.col("__each.i") == 0) | (-F.col("__each.i") == F.col("__last")), F.lit(False)))
    return rows.drop("__found", "__last", "__each", "__whole", "__best")


def directory(path: Column) -> Column:
    """All before the last slash; a path without one lies in ''."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def inherited(files: DataFrame) -> DataFrame:
    """``files`` (path, licence, score, is_file) with ``from_dir`` and ``inherited``: the licence of the nearest directory at or above that has a licence file."""
    files = files.withColumn("__dir", directory(F.col("path")))
    said = files.filter("is_file and licence is not null and __dir is not null").groupBy(F.col("__dir").alias("at")).agg(F.min_by("licence", F.struct((-F.col("score")).alias("s"), "licence")).alias("lic"))
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")))
    dirs = files.filter("__dir is not null").select("__dir").distinct().select(F.col("__dir").alias("of"), F.explode(above).alias("a")).select("of", "a.depth", "a.at")
    nearest = dirs.join(said, "at").groupBy("of").agg(F.max_by(F.struct("at", "lic"), "depth").alias("near"))
    return files.join(nearest, F.col("__dir") == F.col("of"), "left").withColumn("from_dir", F.col("near.at")).withColumn("inherited", F.col("near.lic")).drop("__dir", "of", "near")


def scan(files: DataFrame, *, cutoff: float = 0.6) -> DataFrame:
    """path, licence, score, from_dir, inherited, effective of every row of ``files`` (path, text)."""
    tables = Tables(files.sparkSession, "licenses")
    rows = tables.keep(stated(files.select("path", "text"), cutoff=cutoff).drop("text"), "stated")
    rows = inherited(rows.withColumn("is_file", F.regexp_like("path", F.lit(LICENCE_FILE))))
    return rows.select("path", "licence", "score", "from_dir", "inherited", F.coalesce("licence", "inherited").alias("effective"))


def scan_documents(docs: DataFrame, *, cutoff: float = 0.6, folder: int = 100) -> DataFrame:
    """The scan of ``docs`` (doc_id, text, lang, source), laid out as a tree of files: source/lang/a/b/doc_id with b the hundred and a the hundred hundreds of doc_id.

    The first file of a hundred lies a directory higher, the first of a hundred hundreds two. A file whose first or last sentence states a licence is its directory's licence file.
    """
    tables = Tables(docs.sparkSession, "licenses")
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    number = F.col("doc_id").cast("long")
    level = lambda size: F.when(number % size != 0, F.floor(number / size).cast("string"))
    path = F.concat_ws("/", unknown("source"), unknown("lang"), level(folder * folder), level(folder), number.cast("string"))
    files = docs.select(number.alias("doc_id"), F.when(number.isNotNull(), path).alias("path"), "text")
    rows = tables.keep(stated(files, cutoff=cutoff).drop("text"), "stated")
    rows = inherited(rows.withColumnRenamed("edge", "is_file"))
    return rows.select("doc_id", "path", "licence", "score", "from_dir", "inherited", F.coalesce("licence", "inherited").alias("effective"))
