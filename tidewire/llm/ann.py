"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation and exact reranking.

The nearest vector x to a query q by Euclidean distance is the one with the largest q.x - |x|^2 / 2, so the search is one
for maximum inner product with a term that each row knows exactly. Each group of ``span`` components, less the sample's
mean, is replaced by one of 16 centres, four bits. Centres and codes are chosen for the loss that weighs the part of the
residual parallel to x by ``eta`` and the part orthogonal to it by 1: an error along x changes the scores of just those
queries that score high.

Quantiser and cells are fitted on a sample of bounded size; every row is coded, two codes to a byte, and stored once with
its cell, the nearest of a few hundred coarse centres. A query looks into the cells nearest to it, as many as hold
``share`` of the true neighbours inside the sample, and more where these hold too few rows. Cells are cut into parts of
rows and blocks of queries of bounded size; in each workers add up table entries for all rows of the part, keep the best
few by estimate, ``again`` at least and otherwise the part of the rows that ``share`` of the neighbours needed inside the
sample, and rerank those by exact distance in double precision. The best of all parts are the answer. A table that fills
one cell is searched whole.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of another
length than most have (ties: the smaller). A row without vec_id takes no part. Of rows that repeat a vec_id as a query the
smallest counts; as candidates each does. With fewer candidates than asked for, all are returned. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

CENTRES = 16


class Quantiser:
    """Centres [group, 16, span] and the weights of the loss."""

    def __init__(self, x: np.ndarray, *, span: int = 2, eta: float = 4.0, rounds: int = 5, seed: int = 5):
        self.span, self.eta, self.mean = span, eta, x.mean(axis=0)
        x = self.shifted(x)
        self.groups = x.shape[1] // span
        parts = x.reshape(len(x), self.groups, span)
        rng = np.random.default_rng(seed)
        self.centres = np.zeros((self.groups, CENTRES, span))
        for g in range(self.groups):
            self.centres[g] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), g]
        for _ in range(rounds):
            codes = self.code(x, shifted=True)
            self._move(parts, codes)

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """Less the mean, which changes no distance, and padded with zeros to whole groups."""
        return np.pad(x - self.mean, ((0, 0), (0, -x.shape[1] % self.span)))

    def _directions(self, x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(size > 0, size, 1)).reshape(len(x), self.groups, self.span)

    def code(self, x: np.ndarray, shifted: bool = False, passes: int = 2) -> np.ndarray:
        """A centre for each row and group: nearest first, then group by group the one that lowers the whole row's loss."""
        x = x if shifted else self.shifted(x)
        parts, along = x.reshape(len(x), self.groups, self.span), self._directions(x)
        # residual of each choice: its square, and its part along x
        off = parts[:, :, None, :] - self.centres[None]
        square = (off * off).sum(axis=3)
        ahead = (off * along[:, :, None, :]).sum(axis=3)
        codes = square.argmin(axis=2)
        rows = np.arange(len(x))[:, None]
        total = ahead[rows, np.arange(self.groups)[None], codes].sum(axis=1)
        for _ in range(passes):
            for g in range(self.groups):
                rest = total - ahead[rows[:, 0], g, codes[:, g]]
                loss = square[:, g] + (self.eta - 1) * (rest[:, None] + ahead[:, g]) ** 2
                codes[:, g] = loss.argmin(axis=1)
                total = rest + ahead[rows[:, 0], g, codes[:, g]]
        return codes.astype(np.uint8)

    def _move(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Each group's centres to the minimum of the loss, the others held."""
        along = self._directions(parts.reshape(len(parts), -1))
        rows = np.arange(self.groups)[None]
        for g in range(self.groups):
            chosen = self.centres[rows, codes]
            ahead = ((parts - chosen) * along).sum(axis=2)
            rest = ahead.sum(axis=1) - ahead[:, g]
            for c in np.unique(codes[:, g]):
                mine = codes[:, g] == c
                a, x, r = along[mine, g], parts[mine, g], rest[mine]
                # minimise sum |x - m|^2 + (eta - 1) (r + a.(x - m))^2 over m
                left = mine.sum() * np.eye(self.span) + (self.eta - 1) * a.T @ a
                right = x.sum(axis=0) + (self.eta - 1) * ((r + (a * x).sum(axis=1))[:, None] * a).sum(axis=0)
                self.centres[g, c] = np.linalg.solve(left, right)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Of each query: the inner products with all centres, [query, group, 16]."""
        q = self.shifted(queries).reshape(len(queries), self.groups, self.span)
        return np.einsum("qgs,gcs->qgc", q, self.centres).astype(np.float32)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte, [row, byte]."""
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, : self.groups]

    def scan(self, tables: np.ndarray, codes: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Estimates of q.x - |x|^2 / 2 [query, row]: sums of table entries, one for each group, less ``half``."""
        out = np.broadcast_to(-half.astype(np.float32), (len(tables), len(codes))).copy()
        for g in range(self.groups):
            out += tables[:, g, codes[:, g]]
        return out

    def half(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) ** 2).sum(axis=1) / 2


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


class Cells:
    """Coarse centres, and how many of the nearest a query has to look into."""

    def __init__(self, x: np.ndarray, count: int, *, share: float, k: int, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres = x[rng.choice(len(x), count, replace=False)]
        for _ in range(rounds if count > 1 else 0):
            near = self.order(x)[:, 0]
            for c in np.unique(near):
                self.centres[c] = x[near == c].mean(axis=0)
        self.probes = count
        if count > 1:
            asked, near = x[rng.choice(len(x), min(500, len(x)), replace=False)], self.order(x)[:, 0]
            apart = _square(asked, x).argsort(axis=1, kind="stable")[:, 1 : k + 1]  # the first is the row itself
            rank = np.empty((len(asked), count), np.int64)
            rank[np.arange(len(asked))[:, None], self.order(asked)] = np.arange(count)
            self.probes = int(np.quantile(np.take_along_axis(rank, near[apart], axis=1), share, method="higher")) + 1

    def order(self, x: np.ndarray) -> np.ndarray:
        """All cells of each row, nearest first."""
        return np.concatenate([_square(part, self.centres).argsort(axis=1, kind="stable") for part in np.array_split(x, -(-len(x) // 4096) or 1)])

    def asked(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The cells that each query looks into: its nearest, up to ``probes`` and until they hold ``least`` rows."""
        order = self.order(x)
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        return [o[: max(self.probes, n)] for o, n in zip(order, enough, strict=True)]


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)


def depth(quantiser: Quantiser, cells: Cells, x: np.ndarray, *, share: float, k: int, seed: int = 11) -> float:
    """How much of a cell's rows has to be reranked, best estimates first, to meet ``share`` of the true neighbours among rows ``x``."""
    some = np.random.default_rng(seed).choice(len(x), min(200, len(x)), replace=False)
    near = _square(x[some], x).argsort(axis=1, kind="stable")[:, 1 : k + 1]
    estimates, cell = quantiser.scan(quantiser.tables(x[some]), quantiser.code(x), quantiser.half(x)), cells.order(x)[:, 0]
    parts = []
    for e, found in zip(estimates, near, strict=True):
        for j in found:
            others = e[cell == cell[j]]
            parts.append(((others > e[j]).sum() + 1) / len(others))
    return float(np.quantile(parts, share, method="higher")) if parts else 1.0


def _code(sent, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, cells, _ = sent.value
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                part = b.slice(low, 4096)
                x = _vectors(part.column(1), size)
                codes = quantiser.pack(quantiser.code(x))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.order(x)[:, 0], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "cell", "codes"])

    return run


def _ask(sent, size: int, counts: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value[1]
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part = b.slice(low, 1000)
                into = cells.asked(_vectors(part.column(1), size), counts, least)
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(c) for c in into]))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in part.columns), pa.array(np.concatenate(into), pa.int32())], ["vec_id", "embedding", "cell"])

    return run


def _best(sent, size: int, k: int, again: int):
    """The best of a part of rows for each query of a block."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        (quantiser, _, deep), out = sent.value, ([], [], [])
        if asked.num_rows and rows.num_rows:
            most = max(again, math.ceil(deep * rows.num_rows))
            rows = rows.sort_by("vec_id")  # of equal estimates the first, so the smallest, go on
            vec, x = rows["vec_id"].to_numpy(), _vectors(rows["embedding"].combine_chunks(), size)
            codes = quantiser.unpack(np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(vec), -1))
            half = quantiser.half(x)
            ids, queries = asked["vec_id"].to_numpy(), _vectors(asked["embedding"].combine_chunks(), size)
            for first in range(0, len(ids), 64):
                estimates = quantiser.scan(quantiser.tables(queries[first : first + 64]), codes, half)
                for i, e in enumerate(estimates, first):
                    e[np.searchsorted(vec, ids[i]) : np.searchsorted(vec, ids[i], side="right")] = -np.inf
                    some = np.arange(len(e))
                    if len(e) > most:
                        least = np.partition(e, len(e) - most)[len(e) - most]
                        sure = np.flatnonzero(e > least)
                        some = np.append(sure, np.flatnonzero(e == least)[: most - len(sure)])
                    some = some[vec[some] != ids[i]]
                    apart = np.sqrt(((x[some] - queries[i]) ** 2).sum(axis=1))
                    best = np.lexsort((vec[some], apart))[:k]
                    for column, values in zip(out, (np.full(len(best), ids[i]), vec[some][best], apart[best]), strict=True):
                        column.append(values)
        kinds = pa.int64(), pa.int64(), pa.float64()
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return run


def search(
    vectors: DataFrame, *, every: int = 100, k: int = 10, again: int = 512, sample: int = 8_000, span: int = 2, eta: float = 4.0, cell: int = 50_000, share: float = 0.99, part: int = 50_000, block: int = 2048, most_cells: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the ``k`` nearest others found in ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    tables, schema = Tables(spark, "ann"), "query_id bigint, rank int, vec_id bigint, score double"
    numbers = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    usable = usable.filter(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    sizes = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if not sizes:
        return spark.createDataFrame([], schema)
    size, n = sizes["size"], sizes["count"]
    usable = usable.filter(F.size("embedding") == size)
    count = min(most_cells, -(-n // cell))
    fitted = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 32 * count)).toArrow()  # 32,768 rows at most
    x = _vectors(fitted["embedding"].combine_chunks(), size)
    quantiser = Quantiser(x[:sample], span=span, eta=eta)
    cells = Cells(x, min(count, len(x)), share=share, k=k)
    sent = spark.sparkContext.broadcast((quantiser, cells, depth(quantiser, cells, x[:sample], share=share, k=k)))

    coded = usable.mapInArrow(_code(sent, size), "vec_id bigint, embedding array<double>, cell int, codes binary").withColumn("row", F.monotonically_increasing_id())
    coded = tables.keep(coded, "coded")
    counts = np.zeros(count, np.int64)
    for r in coded.groupBy("cell").count().collect():  # a row for each cell
        counts[r["cell"]] = r["count"]
    asked = coded.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = tables.keep(asked.mapInArrow(_ask(sent, size, counts, 8 * k), "vec_id bigint, embedding array<double>, cell int"), "asked")
    grid = coded.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "cell")
    grid = F.broadcast(grid)  # a row for each cell
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(grid, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", upto("parts"))
    right = coded.join(grid, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("block", upto("blocks"))
    key = "cell", "part", "block"
    pairs = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "vec_id", "embedding", "codes").groupBy(*key))
    found = pairs.applyInArrow(_best(sent, size, k, again), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
