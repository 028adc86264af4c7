"""Best-fit packing of tokenised documents into sequences of fixed length, by minimum bin slack.

Each bin is filled as well as the lengths still there allow: its largest piece first, then the fullest feasible
combination of others by subset sums held in one bitset, a bit for each reachable sum. Lengths are small integers, so
the search works on counts by length - at most ``capacity`` numbers, however many documents there are - and a
combination is removed as often as its counts allow in one step. Rows meet the plan again by their rank among the
pieces of their length.

Defined results: a document is its tokens and one end token, so null and empty texts are one token. A document longer
than the capacity is cut into full pieces, the first of which may be shorter. Rows that repeat a doc_id are packed each.
A null doc_id is carried along. Empty table: no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, released

SALTS = 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt int"
KINDS = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()


#: Fixed value: how the byte-level pre-tokeniser splits a text, written without backtracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def ranked(told: dict) -> tiktoken.Encoding | None:
    """The tokenizer that a file describes as byte pairs with ranks, which is several times faster; None for one of another kind."""
    bpe, before, added = told["model"], told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
    plain = bpe.get("type") == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    if any(not t["special"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        return None
    special, byte = {t["content"]: t["id"] for t in added}, _bytes_of_letters()
    ranks = {bytes(map(byte.__getitem__, k)): n for k, n in bpe["vocab"].items() if k not in special}
    made = [bpe["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in bpe["merges"]]
    if made != sorted(made) or len(made) + 256 != len(ranks):  # merges in order of ids, and no others
        return None
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Token ids, as little-endian bytes, of whole texts as ``tokenizers`` gives them for the file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.fast = ranked(json.load(f))
        if self.fast is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)

    def slow(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if self.fast else self.slow(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker: it outlives a task, and holds nothing of the data."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = encoder(path), 0
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part, out = b.slice(low, 1000), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    body = memoryview(known.ids(text.as_py() or "") + tail)
                    n = len(body) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = min(n, capacity) if start or n <= capacity else n % capacity or capacity
                        at += 1
                        out.append((doc_id, piece, start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), at % SALTS))
                        start, piece = start + length, piece + 1
                columns = zip(*out, strict=True) if out else [()] * len(KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of lengths with counts: how many of each to take so that their sum is as close to ``room`` as can be, not above. Larger lengths are tried first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins), in order."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        used = fullest({k: v for k, v in counts.items() if v}, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


INTERVALS = "length bigint, low bigint, high bigint, each bigint, base bigint, at bigint"


def intervals(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """Which ranks of a length go to which bins: (length, low, high, pieces a bin, first bin, offset of the first such piece)."""
    rank: dict[int, int] = {}
    base, out = 0, []
    for used, times in bins:
        at = 0
        for length in sorted(used, reverse=True):
            n, low = used[length], rank.get(length, 0)
            out.append((length, low, low + n * times, n, base, at))
            rank[length] = low + n * times
            at += n * length
        base += times
    return out


def pack(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    pieces = tables.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_pieces(tokenizer, capacity, end)), PIECES), "pieces")
    cells = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = spark.createDataFrame(intervals(plan(counts, capacity)), INTERVALS)  # a few for each length, whatever the number of rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = pieces.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(cells, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("skip")).alias("p")
    w = F.broadcast(where).alias("w")
    placed = ranked.join(w, (F.col("p.length") == F.col("w.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    local = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32", (F.col("base") + F.expr("(rank - low) div each")).alias("sequence_id"), (F.col("at") + (local % F.col("each")) * F.col("p.length")).alias("offset"))
