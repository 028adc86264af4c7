"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (1 to 3 letters, word ends marked) in order. A document's own
list is compared with each profile by out-of-place distance: the sum, over the document's n-grams, of how far each
stands from its place in the profile, with the profile's length for those it lacks. The nearest profile names the
language; the score is one less the distance over the largest possible one.

Profiles come from all training rows: workers count n-grams by language and sums are shuffled. Per language the lists
are bounded, so only ``keep`` n-grams of each bucket reach the driver.

An n-gram is held as one integer of its code points, which also breaks ties of frequency.

Defined results: a null text or one without a letter is ``und`` with score 0; so is everything when nothing can be
learned. A row without doc_id is never learned from. Rows that repeat are answered each. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

KEEP, LONGEST = 300, 3
BUCKETS = 64
WIDEST = 100  # different characters up to which counts fit a table


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if codes.max(initial=0) < len(_LETTER):
        return _LETTER[codes]
    found, at = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() for c in found])[at]


_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, a space for all that is no letter, one at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    out = np.full(len(codes) + 2, 32, np.int64)
    out[1:-1] = np.where(_letters(codes), codes, 32)
    return out


def grams(p: np.ndarray) -> np.ndarray:
    """The n-grams of a row of code points, each as an integer: letters, pairs with a letter, and triples with a letter in the middle."""
    is_letter = p != 32
    two = p[:-1] << 21 | p[1:]
    three = two[:-1] << 21 | p[2:]
    return np.concatenate([p[is_letter], two[is_letter[:-1] | is_letter[1:]], three[is_letter[1:-1]]])


def _best(found: np.ndarray, n: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` most frequent, most frequent first, ties to the smaller integer."""
    if len(n) > keep:
        chosen = np.flatnonzero(n >= np.partition(n, len(n) - keep)[len(n) - keep])
        found, n = found[chosen], n[chosen]
    return found[np.argsort(-n, kind="stable")[:keep]]


def ranked(text: str, keep: int = KEEP) -> np.ndarray:
    """The most frequent n-grams of a text in order."""
    return _best(*np.unique(grams(points(text)), return_counts=True), keep)


def _counted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of many code points, and how often each occurs."""
    alphabet = np.flatnonzero(np.bincount(p, minlength=33)) if p.max() < len(_LETTER) else []
    size = len(alphabet)
    if not 0 < size <= WIDEST:
        return np.unique(grams(p), return_counts=True)
    table = np.zeros(alphabet[-1] + 1, np.int64)
    table[alphabet] = np.arange(size)
    code = table[p]
    is_letter = p != 32
    two = code[:-1] * size + code[1:]
    three = two[:-1] * size + code[2:]
    out = []
    for codes, width in ((code[is_letter], 1), (two[is_letter[:-1] | is_letter[1:]], 2), (three[is_letter[1:-1]], 3)):
        n = np.bincount(codes, minlength=1)
        at = np.flatnonzero(n)
        gram = sum(alphabet[at // size ** (width - 1 - i) % size] << 21 * (width - 1 - i) for i in range(width))
        out.append((gram, n[at]))
    return np.concatenate([g for g, _ in out]), np.concatenate([n for _, n in out])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed over about a million characters at a time."""

    def emit(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        sums = [(lang, *_counted(np.concatenate(parts))) for lang, parts in held.items()]
        langs = [lang for lang, g, _ in sums for _ in range(len(g))]
        empty = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([empty, *(g for _, g, _ in sums)])), pa.array(np.concatenate([empty, *(n for *_, n in sums)]))], ["lang", "gram", "n"])

    held, size = {}, 0
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            p = points(text.as_py())
            held.setdefault(lang.as_py(), []).append(p)
            size += len(p)
            if size > 1_000_000:
                yield emit(held)
                held, size = {}, 0
    yield emit(held)


def profiles(docs: DataFrame, *, folds: int = 5, keep: int = KEEP) -> dict[str, np.ndarray]:
    """Ranked n-grams of each language, from training rows of ``docs`` (doc_id, text, lang) with a language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(~held_out(F.col("doc_id"), folds))
    sums = rows.select("lang", "text").mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("lang", "bucket").orderBy(F.col("n").desc(), "gram")
    top = sums.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS))).withColumn("r", F.row_number().over(within)).filter(F.col("r") <= keep)
    got = top.select("lang", "gram", "n").toPandas().sort_values(["n", "gram"], ascending=[False, True])  # BUCKETS * keep rows a language at most
    return {lang: g["gram"].to_numpy(np.int64)[:keep] for lang, g in got.groupby("lang")}


class Profiles:
    """All profiles as one table: a row of places for each n-gram, the profile's length where a language lacks it."""

    def __init__(self, lists: dict[str, np.ndarray], keep: int = KEEP):
        self.langs, self.keep = sorted(lists), keep
        self.keys = np.unique(np.concatenate([lists[x] for x in self.langs])) if lists else np.empty(0, np.int64)
        self.places = np.full((len(self.keys) + 1, len(self.langs)), keep, np.int32)
        for k, lang in enumerate(self.langs):
            self.places[np.searchsorted(self.keys, lists[lang]), k] = np.arange(len(lists[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.keep) if text and self.langs else ()
        if not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = np.where(self.keys[at] == own, at, len(self.keys))
        place = self.places[at]
        apart = np.where(place < self.keep, np.abs(place - np.arange(len(own))[:, None]), self.keep).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.keep * len(own)))


def identify(docs: DataFrame, *, folds: int = 5, keep: int = KEEP) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(profiles(docs, folds=folds, keep=keep), keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            both = [p.nearest(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score")
