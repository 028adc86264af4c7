"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of word pairs over the training documents are quantised to levels on a logarithmic scale, and an
n-gram of level q enters the filter q times, as (n-gram, 1) to (n-gram, q). A count is read back by asking for level 1,
2, ... until one is missing. The filter is held in segments, each with the n-grams of one range of hashes and with
``bits`` for each of its entries: it grows with the corpus, and its rate of false positives (``Filter.false_rate``) stays.

Nothing is gathered or broadcast. Documents are cut into pieces of about ``PIECE`` tokens. The distinct n-grams of a piece
go to their segments once, with their counts in the piece's training documents; a segment sums them up, builds its part
of the filter, probes it for every n-gram that was asked, and answers each piece with levels, and for words with exact
counts. Answers meet the pieces again, and each document is scored from them. A segment has a bounded number of n-grams in
any corpus, as the number of segments grows with it.

The model's probability of a word w after h is (c(h, w) + mu * p(w)) / (c(h) + mu) with p(w) additively smoothed, all
counts read from the filter, each at the middle of its level; c(h, w) counts as c(h) at most. The first word follows a
start mark. Pairs enter the filter from ``least`` occurrences on: all of them, unless a caller asks for a cutoff. The base
score uses exact counts.

Defined results: a null text is empty: one token, the end mark. A row without doc_id is scored and never learned from.
Rows that repeat are counted and scored each. With no training documents no token is known; each counts as 0.1 of 0.1.
Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Tables, held_out, mix, text_bytes

#: Hashes of the marks, outside of what words hash to in practice.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
PROBES = 3
#: Training tokens for each segment of the filter; tokens of a piece of documents.
SEGMENT, PIECE = 3_000_000, 500_000
#: N-grams that enter or are asked of a filter at a time.
AT_ONCE = 200_000


def pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + w)


def levels(base: float) -> np.ndarray:
    """The smallest count of each level."""
    out, q = [1], 1
    while out[-1] < 1e15:
        q += 1
        out.append(max(out[-1] + 1, math.ceil(base ** (q - 1) - 1e-9)))
    return np.array(out, np.float64)


class Filter:
    """Bits of a log-frequency Bloom filter."""

    def __init__(self, bits: np.ndarray, base: float):
        self.bits, self.size, floor = bits, np.uint64(len(bits) * 8), levels(base)
        self.middle = np.append(0.0, np.append((floor[:-1] + floor[1:] - 1) / 2, floor[-1]))

    @staticmethod
    def places(keys: np.ndarray, level: np.ndarray | int, size: np.uint64) -> np.ndarray:
        """Bit numbers [key, probe] of (n-gram, level)."""
        a = mix(keys + np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        b = mix(a) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % size

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        at = self.places(keys, level, self.size)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams, each asked for one by one until one is missing; ``AT_ONCE`` of them at a time, as their places take many times their room."""
        level = np.zeros(len(keys), np.uint8)
        for at in range(0, len(keys), AT_ONCE):
            some, live = keys[at : at + AT_ONCE], np.arange(min(AT_ONCE, len(keys) - at))
            for asked in range(1, len(self.middle)):
                live = live[self.has(some[live], asked)]
                if not len(live):
                    break
                level[at + live] = asked
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return self.middle[self.levels(keys)]

    def false_rate(self) -> float:
        full = int(np.bitwise_count(self.bits).sum(dtype=np.int64)) / max(1, int(self.size))
        return full**PROBES


def fill(keys: np.ndarray, c: np.ndarray, size: int, base: float) -> np.ndarray:
    """The bits, ``size`` in number, of n-grams with their counts."""
    floor, flags = levels(base), np.zeros(size, bool)
    for at in range(0, len(keys), AT_ONCE):
        some = keys[at : at + AT_ONCE]
        q = np.searchsorted(floor, c[at : at + AT_ONCE], side="right")
        level = np.arange(1, q.sum() + 1) - np.repeat(np.cumsum(q) - q, q)
        flags[Filter.places(np.repeat(some, q), level, np.uint64(size)).ravel()] = True
    return np.packbits(flags, bitorder="little")


def build(entries: DataFrame, size: int, base: float) -> Filter:
    """One filter of a small table (key, c)."""
    rows = entries.select("key", "c").toPandas()
    return Filter(fill(rows["key"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64), size, base), base)


def edges(segments: int) -> np.ndarray:
    """Where the ranges of hashes of all segments but the first begin."""
    return np.array([(i << 64) // segments for i in range(1, segments)], np.uint64)


def planes(v: np.ndarray, kind: type = np.uint32) -> bytes:
    """Whole numbers, their bytes by rank: high ones are mostly zero, and compress away."""
    v = np.ascontiguousarray(v, kind)
    return v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes()


def values(b: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def within(keys: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes by segment, as 32-bit places in the segment's range. A segment has a bounded number of n-grams, so two of them meet at one place as rarely in any corpus."""
    shift = np.uint64(max(0, (((1 << 64) - 1) // (len(edge) + 1)).bit_length() - 32))
    return [((k - low) >> shift).astype(np.uint32) for k, low in zip(np.split(keys, np.searchsorted(keys, edge)), np.append(np.uint64(0), edge), strict=True)]


PIECES = "ids array<bigint>, sizes array<int>, learned array<boolean>, n bigint, words binary, tokens binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, about PIECE tokens a row: ids, sizes, which are learned from and how many tokens these have, the distinct words by frequency (the start mark last), and each token's number among them."""
    ids, docs, learned, held = [], [], [], 0

    def emit() -> pa.RecordBatch:
        words, token, times = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        sizes = np.array([len(d) for d in docs])
        row = [[ids.copy()], [sizes.tolist()], [learned.copy()], [int(sizes[np.array(learned, bool)].sum())], [np.append(words[order], START).tobytes()], [pa.compress(planes(number[token]), "zstd", asbytes=True)]]
        ids.clear(), docs.clear(), learned.clear()
        kinds = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["ids", "sizes", "learned", "n", "words", "tokens"])

    for b in batches:
        for doc_id, text, learn in zip(b.column("doc_id"), b.column("__bytes"), b.column("__learned"), strict=True):
            docs.append(np.append(WORDS.of(text.as_py().lower().split()), END))
            ids.append(doc_id.as_py())
            learned.append(learn.as_py())
            held += len(docs[-1])
            if held >= PIECE:
                yield emit()
                held = 0
    if docs:
        yield emit()


class Piece:
    """A piece's words and distinct pairs, sorted by hash, and for each token its place among the words, that of what stands before it, and that of the pair."""

    def __init__(self, words: bytes, tokens: bytes, sizes: np.ndarray):
        words, self.sizes = np.frombuffer(words, np.uint64), sizes
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words = words[order]
        self.token = place[values(pa.decompress(tokens, 4 * int(sizes.sum()), "zstd", asbytes=True))]
        self.start = int(place[-1])
        self.before = np.roll(self.token, 1)
        self.before[np.cumsum(sizes) - sizes] = self.start
        self.pairs, self.pair = np.unique(pair(self.words[self.before], self.words[self.token]), return_inverse=True)


CELLS = "piece bigint, seg int, words binary, times binary, pairs binary, often binary"


def _cells(edge: np.ndarray):
    """The distinct n-grams of pieces with their training counts, those of a segment in a row. The start mark counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, words, tokens, sizes, learned in zip(*(b.column(c) for c in ("piece", "words", "tokens", "sizes", "learned")), strict=True):
                p, learned = Piece(words.as_py(), tokens.as_py(), sizes.values.to_numpy()), learned.values.to_numpy(zero_copy_only=False).astype(bool)
                of = np.repeat(learned, p.sizes)
                times = np.bincount(p.token[of], minlength=len(p.words))
                times[p.start] = learned.sum()
                often = np.bincount(p.pair[of], minlength=len(p.pairs))
                at, by = np.searchsorted(p.words, edge), np.searchsorted(p.pairs, edge)
                cut = np.split(p.words, at), np.split(times, at), within(p.pairs, edge), np.split(often, by)
                some = [i for i in range(len(edge) + 1) if len(cut[0][i]) or len(cut[2][i])]
                columns = [[cut[0][i].tobytes() for i in some], [planes(cut[1][i]) for i in some], [planes(np.diff(cut[2][i], prepend=np.uint32(0))) for i in some], [planes(cut[3][i]) for i in some]]
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["piece", "seg", "words", "times", "pairs", "often"])

    return run


def _joined(column: pa.ChunkedArray, read, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and where each row but the first begins."""
    rows = [read(x.as_py()) for x in column]
    return np.concatenate([np.empty(0, kind), *rows]), np.cumsum([len(x) for x in rows])[:-1]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of each, and the place of each key among them."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=times, minlength=len(distinct)).astype(np.int64), at


ANSWERS = "piece bigint, seg int, entries bigint, n bigint, known bigint, bits binary, counts binary, words binary, pairs binary"


def _segment(edge: np.ndarray, base: float, bits: int, least: int):
    """From the cells of a segment: its part of the filter in a row without a piece, with its tokens and words; and for each cell exact counts of its words and the levels that the filter has of its words and pairs."""

    def run(t: pa.Table) -> pa.Table:
        seg = t["seg"][0].as_py()
        words, cut = _joined(t["words"], lambda x: np.frombuffer(x, np.uint64), np.uint64)
        words, times, at = _summed(words, _joined(t["times"], values, np.uint32)[0])
        pairs, split = _joined(t["pairs"], lambda x: np.cumsum(values(x), dtype=np.uint32), np.uint32)
        pairs, often, which = _summed(pairs, _joined(t["often"], values, np.uint32)[0])
        place, real, pairs = within(words, edge)[seg].astype(np.uint64), words != START, pairs.astype(np.uint64)
        keys, c = np.append(place[times > 0], pairs[often >= least]), np.append(times[times > 0], often[often >= least])
        entries = int(np.searchsorted(levels(base), c, side="right").sum())
        made = Filter(fill(keys, c, max(1, -(-entries * bits // 8)) * 8, base), base)
        found = [[x.tobytes() for x in np.split(made.levels(k)[a], e)] for k, a, e in ((place, at, cut), (pairs, which, split))]
        exact = [planes(x, np.uint64) for x in np.split(times[at], cut)]
        n, none = t.num_rows, [None]
        columns = [
            none + t["piece"].to_pylist(), [seg] * (n + 1), [entries] + none * n, [int(times[real].sum())] + none * n, [int((times[real] > 0).sum())] + none * n, [made.bits.tobytes()] + none * n,
            none + exact, none + found[0], none + found[1],
        ]
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["piece", "seg", "entries", "n", "known", "bits", "counts", "words", "pairs"])

    return run


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(total: int, distinct: int, mu: float, base: float):
    """A row for each document of a piece, from the answers of the segments."""
    scale, middle = total + 0.1 * (distinct + 1), Filter(np.zeros(1, np.uint8), base).middle

    def run(piece: pa.Table, found: pa.Table) -> pa.Table:
        sizes = piece["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64)
        p, n = Piece(piece["words"][0].as_py(), piece["tokens"][0].as_py(), sizes), len(sizes)
        found = found.sort_by("seg")
        exact = _joined(found["counts"], lambda x: values(x, np.uint64), np.uint64)[0]
        count, joint = (middle[_joined(found[c], lambda x: np.frombuffer(x, np.uint8), np.uint8)[0]] for c in ("words", "pairs"))
        owner = np.repeat(np.arange(n), sizes)
        plain = np.bincount(owner, weights=np.log10((exact + 0.1) / scale)[p.token], minlength=n)
        known = np.bincount(owner, weights=(exact > 0)[p.token], minlength=n).astype(np.int64)
        # the model: each distinct pair's probability once
        first = np.empty(len(p.pairs), np.int64)
        first[p.pair] = np.arange(len(p.pair))
        h, w = p.before[first], p.token[first]
        each = np.log10((np.minimum(joint, count[h]) + mu * (count[w] + 0.1) / scale) / (count[h] + mu))
        score = np.bincount(owner, weights=each[p.pair], minlength=n)
        ids, held = piece["ids"].combine_chunks().flatten(), pc.invert(piece["learned"].combine_chunks().flatten())
        return pa.table([ids, held, pa.array(sizes), pa.array(known), pa.array(plain), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _answered(tables: Tables, docs: DataFrame, segment: int, base: float, bits: int, least: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Pieces of ``docs`` (doc_id, __bytes, __learned), the answers of the segments, and where segments begin."""
    pieces = tables.keep(docs.mapInArrow(_pieces, PIECES).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    size = pieces.agg(F.sum("n")).first()[0] or 0
    edge = edges(max(1, math.ceil(size / segment)))
    cells = pieces.select("piece", "words", "tokens", "sizes", "learned").mapInArrow(_cells(edge), CELLS)
    return pieces, tables.keep(cells.groupBy("seg").applyInArrow(_segment(edge, base, bits, least), ANSWERS), "answers"), edge


def segments(train: DataFrame, *, segment: int = SEGMENT, least: int = 1, base: float = 1.5, bits: int = 12) -> tuple[DataFrame, np.ndarray]:
    """The filter of training documents (__bytes), a row (seg, entries, n, known, bits) a segment, and where segments begin."""
    docs = train.select(F.lit(None).cast("long").alias("doc_id"), "__bytes", F.lit(True).alias("__learned"))
    _, answers, edge = _answered(Tables(train.sparkSession, "lm"), docs, segment, base, bits, least)
    return answers.filter("piece is null").select("seg", "entries", "n", "known", "bits"), edge


def score(docs: DataFrame, *, folds: int = 10, least: int = 1, mu: float = 300.0, base: float = 1.5, bits: int = 12, segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("__bytes"), (~held_out(F.col("doc_id").cast("long"), folds)).alias("__learned"))
    pieces, answers, _ = _answered(Tables(docs.sparkSession, "lm"), docs, segment, base, bits, least)
    total, distinct = answers.filter("piece is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    found = answers.filter("piece is not null").select("piece", "seg", "counts", "words", "pairs")
    scored = pieces.groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(_score(total, distinct, mu, base), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
