"""Near-duplicate documents: MinHash bands for candidates, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct shingles of five words (ASCII letters lower-cased); with fewer words the whole
sequence is its one shingle. Documents whose sets overlap by a Jaccard similarity of 0.75 or more are linked, and a
component holds what links reach.

How no group is paired out in full:

1. Documents with equal sets become one class (its smallest doc_id), by a fingerprint of the set, before anything else.
2. In each bucket of a band every class meets only the bucket's leader. As a class has many buckets and leaders, this
   joins nearly all of a group of near copies into one component. Its cost is linear in the bucket.
3. What is left - classes of buckets of three or more in which classes of different components never met - meets again
   by an exact filter: two sets of the wanted similarity share one of their rarest shingles, a quarter of each set. A
   passage that many documents share is not among these, so it makes no pairs. Classes with such a shingle in common
   are compared in blocks inside numpy, where pairs of one component are skipped. Near copies of one lost original can
   be thousands that are all similar but not enough; so by its commonest rare shingles, a few for each class, blocks
   carry the full sets and only true links leave. Blocks of the other shingles carry signatures, skip what the first
   have compared, and pass on surviving pairs.

Candidates go through the sequential test (Bayesian LSH): after each batch of 16 signature values a pair is dropped
when the posterior chance that its similarity reaches the threshold is under ``miss``. The first 128 values decide most
pairs; only for the rest the other 384 are looked up. A value is kept in 8 bits; chance matches only keep pairs. Survivors are confirmed on the
full sets made from the texts.

Defined results: null or empty text: 0 shingles, linked with nothing. Rows that repeat a doc_id are answered each by
its own text. A row without doc_id takes part in nothing: component_id null, kept true. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, Tables, chain, lists, mix, released, text_bytes

HASHES, FIRST, ROWS, BATCH = 512, 128, 4, 16
BANDS = FIRST // ROWS
WIDTH = 5
#: Rows of a block, and shingles of a block of full sets.
BLOCK, SHINGLES = 512, 1_000_000
HOMES, CROWD = 4, 16
#: Tables of ids are written by one task for so many partitions of a shuffle.
GATHER = 16
COUNTER_BITS = 20
COUNTERS = 1 << COUNTER_BITS

_rng = np.random.default_rng(20240817)
_MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = WORDS.of(words)
    if n < width:
        return chain([np.array([n], np.uint64), *(h[i : i + 1] for i in range(n))])
    return np.unique(chain([h[i : n - width + 1 + i] for i in range(width)]))


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest 32-bit value of each of the hash functions over a set, in slices so that long texts stay in memory. (Processors multiply 32 bits many at a time.)"""
    out, x = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32), s.astype(np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * _MULTIPLY + _ADD).min(axis=0), out=out)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            n, fp1, fp2, sigs, more, bands = [], [], [], [], [], []
            for t in part.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                fp1.append(int(mix(s).sum(dtype=np.uint64)))
                fp2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(0x51ED270B)))) if len(s) else 0)
                if len(s):
                    m = signature(s)
                    low = ((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                    sigs.append(low[:FIRST].tobytes())
                    more.append(low[FIRST:].tobytes())
                    q = m[:FIRST].astype(np.uint64).reshape(BANDS, ROWS)
                    bands.append(mix(chain([q[:, i] for i in range(ROWS)]) ^ _BAND).view(np.int64))
                else:
                    sigs.append(b"")
                    more.append(b"")
                    bands.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(np.array(fp1, np.uint64).view(np.int64)), pa.array(np.array(fp2, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array(more, pa.binary()), lists(bands, pa.int64())],
                ["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "sig", "more", "bands"],
            )


SKETCH = "doc_id bigint, text_hash bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sig binary, more binary, bands array<bigint>"


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that go on): posterior of the similarity from a uniform prior, Beta(m + 1, n - m + 1)."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:  # P(similarity >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss or m == n:
                break
            m += 1
        out.append((n, m))
    return out


def _survivors(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]], hits: np.ndarray | int = 0, done: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the signature pairs that no batch rules out, and the matches of each; ``hits`` of ``done`` values came before."""
    live, hits, start = np.arange(len(a)), hits + np.zeros(len(a), np.int64), done
    for n, least in bounds:
        if start < n <= start + a.shape[1]:
            hits[live] += (a[live, done - start : n - start] == b[live, done - start : n - start]).sum(axis=1)
            live, done = live[hits[live] >= least], n
            if not len(live):
                break
    return live, hits[live]


def _matrix(sigs) -> np.ndarray:
    sigs = sigs.to_pylist()
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def _judge(bounds, done: int):
    """Rows (a, b, hits, one signature, the other) that go on after the values in the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                live, hits = _survivors(_matrix(b.column(3)), _matrix(b.column(4)), bounds, b.column(2).to_numpy(), done)
                at = pa.array(live)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(hits)], ["a", "b", "hits"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for b in batches:
            good = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x = x.as_py()
                if x != last:
                    last, kept = x, shingles(x)
                other = shingles(y.as_py())
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(other) - both):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], ["a", "b"])

    return run


def _by_signature(bounds):
    """The comparer of a cell's rows (rep, comp, side, signature, homes): pairs of different components without a home in common that may be similar."""

    def cell(rep, comp, side, sigs, homes):
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, FIRST)
        home = np.array([[*h, *[0] * (HOMES - len(h))] for h in homes], np.int64)
        for i in np.flatnonzero(side <= 0):
            j = _others(i, comp, side)
            if len(j):
                met = ((home[j][:, :, None] == home[i]) & (home[i] != 0)).any(axis=(1, 2))
                j = j[~met]
                ok, _ = _survivors(np.broadcast_to(sig[i], (len(j), FIRST)), sig[j], bounds)
                yield from ((i, k) for k in j[ok])

    return cell


def _by_set(percent: int):
    """The comparer of a cell's rows (rep, comp, side, full set, -): true links between different components. Sets are held as numbers of the cell's shingles, so a row meets all others in one pass."""

    def cell(rep, comp, side, sets, _):
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        size = np.array([len(x) for x in sets])
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        start, mark = np.cumsum(size) - size, np.zeros(number.max() + 1, bool)
        for i in np.flatnonzero(side <= 0):
            j = _others(i, comp, side)
            j = j[(100 * size[j] >= percent * size[i]) & (100 * size[i] >= percent * size[j])]
            if len(j):
                own = number[start[i] : start[i] + size[i]]
                mark[own] = True
                both = np.array([np.count_nonzero(mark[number[start[k] : start[k] + size[k]]]) for k in j])
                mark[own] = False
                yield from ((i, k) for k in j[100 * both >= percent * (size[i] + size[j] - both)])

    return cell


def _others(i: int, comp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whom row i of a cell is compared with: the other block, or in a block's own cell the rows after it."""
    j = np.flatnonzero((side >= 0) & (comp != comp[i]))
    return j if side[i] else j[j > i]


def _cells(compare):
    """Over rows (key, cell, side, rep, comp, payload, homes) sorted by (key, cell): the pairs that ``compare`` finds in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def flush():
            if len(rows) > 1:
                side, rep, comp, load, homes = zip(*rows, strict=True)
                rep = np.array(rep)
                out.extend((int(min(rep[i], rep[k])), int(max(rep[i], rep[k]))) for i, k in compare(rep, np.array(comp), np.array(side), load, homes))

        for b in batches:
            for key, c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (key, c) != now:
                    flush()
                    now, rows = (key, c), []
                rows.append(row)
            if len(out) > 10_000:
                yield _pairs(list(set(out)))
                out = []
        flush()
        yield _pairs(list(set(out)))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, b.num_rows, 1000):
            part = b.slice(low, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["rep", "load"])


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often shingles fall on each of a fixed number of counters."""
    n = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for t in b.column(1):
            np.add.at(n, (shingles(t.as_py()) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["at", "n"])


def _rarest(often, percent: int):
    """The shingles of each set that come first when the rarest do, as many as two sets of the wanted similarity cannot both have to themselves. Any one order for all sets is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = often.value
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part, keys, sizes = b.slice(low, 1000), [], []
                for t in part.column(1):
                    s = shingles(t.as_py())
                    order = np.lexsort((s, n[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
                    keys.append(s[order[: len(s) + (-percent * len(s)) // 100 + 1]].view(np.int64))
                    sizes.append(len(s))
                each = [len(k) for k in keys]
                reps = np.repeat(part.column(0).to_numpy(), each)
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.repeat(sizes, each), pa.int64())], ["rep", "key", "size"])

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def gathered(tables: Tables, ids: DataFrame, name: str) -> DataFrame:
    """``ids``, rows of a few numbers, from a table of few files: each file costs a task attempt's folders and, in a local store, several commands, however
    small it is. What makes the rows stays dealt out as it was; only finished rows are dealt again, evenly and by no key."""
    n = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    return tables.keep(ids.repartition(max(2, n // GATHER)), name)


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), by smallest labels of neighbours and pointer jumping."""
    both = gathered(tables, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = gathered(tables, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("comp").alias("low"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = gathered(tables, step.join(jump, "comp", "left").select("node", "old", F.least(F.col("comp"), F.col("root")).alias("comp")), "labels")
        changed = new.filter("old <> comp").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, *, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text), and xxhash64 of its text's bytes, text_hash."""
    spark = docs.sparkSession
    tables, bounds = Tables(spark, "neardup"), least_matches(percent / 100, miss)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    sketch = tables.keep(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(released(_sketch), SKETCH), "sketch")
    usable = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = tables.keep(usable.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("sig").alias("sig"), F.first("more").alias("more"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b): those that the sequential test leaves and the full sets confirm."""
        left = pairs.filter("a <> b").distinct().withColumn("hits", F.lit(0).cast("long"))
        for column, done in (("sig", 0), ("more", FIRST)):
            of = lambda p: classes.select(F.col("rep").alias(p), F.col(column).alias(f"s_{p}"))  # noqa: E731, B023
            signed = left.join(of("a"), "a").join(of("b"), "b").select("a", "b", "hits", "s_a", "s_b")
            left = gathered(tables, signed.mapInArrow(_judge(bounds, done), "a bigint, b bigint, hits bigint").dropDuplicates(["a", "b"]), "survivors")
        left = left.select("a", "b")
        texts = source.join(left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct(), "doc_id", "left_semi")
        full = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return gathered(tables, full.select("a", "b", "text_a", "text_b").mapInArrow(released(_confirm(percent)), "a bigint, b bigint").distinct(), "links")

    # Each class meets the leader of its bucket, the smallest.
    leaders = banded.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
    links = confirmed(banded.join(leaders, "key").select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    labels = components(tables, links)

    # Classes that shared a bucket with another component and may not have met it.
    def placed(keyed: DataFrame) -> DataFrame:
        return keyed.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"), *(c for c in ("size",) if c in keyed.columns))

    def mixed(rows: DataFrame, least: int) -> DataFrame:
        return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(f"n >= {least} and lo <> hi").select("key", "n")

    at = placed(banded)
    unmet = at.join(mixed(at, 3), "key").select(F.col("rep").alias("doc_id")).distinct()
    texts = tables.keep(source.join(unmet, "doc_id", "left_semi"), "unmet")
    often = np.zeros(COUNTERS, np.int64)
    sums = texts.mapInArrow(_counters, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    often[sums["at"].to_numpy()] = sums["n"].to_numpy()
    rare = tables.keep(texts.mapInArrow(_rarest(spark.sparkContext.broadcast(often), percent), "rep bigint, key bigint, size bigint"), "rare")
    at = placed(rare)
    rest = gathered(tables, at.join(mixed(at, 2), "key"), "rest")
    crowded = rest.filter(F.col("n") > CROWD)
    chosen = crowded.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), "key"))).filter(F.col("r") <= HOMES)
    chosen = gathered(tables, chosen.select("key", "rep", "comp", "size"), "homes")
    homes = chosen.groupBy("rep").agg(F.collect_list("key").alias("homes"))  # HOMES keys at most
    none = F.array().cast("array<bigint>")

    def compared(rows: DataFrame, compare) -> DataFrame:
        """(a, b) that ``compare`` finds in rows (key, n, rep, comp, load, homes). A key of n classes has ceil(n / BLOCK) blocks; a cell joins two of them."""
        rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
        cells = rows.select("key", cell.alias("cell"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "rep", "comp", "load", "homes")
        return cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_cells(compare), "a bigint, b bigint")

    counted = chosen.groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") * BLOCK / SHINGLES)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", "n")
    full = texts.join(chosen.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets, "rep bigint, load binary")
    true = compared(chosen.join(counted, "key").join(full, "rep").withColumn("homes", none), _by_set(percent))
    others = rest.drop("size").join(classes.select("rep", F.col("sig").alias("load")), "rep").join(homes, "rep", "left").withColumn("homes", F.coalesce("homes", none))
    last = gathered(tables, true.distinct(), "crowds").union(confirmed(compared(others, _by_signature(bounds))))
    labels = components(tables, links.union(last))

    # Each row's component is its class's. Rows without shingles have none, and classes with a thousandth of all rows, of which there are a thousand at most, are sent to the rows.
    named = gathered(tables, classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "n_shingles", "members", F.coalesce("comp", "rep").alias("comp")), "components")
    key, rows = ["fp1", "fp2", "n_shingles"], sketch.select("doc_id", "n_shingles", "fp1", "fp2", "text_hash")
    large = F.broadcast(named.filter(F.col("members") * 1000 >= max(1000, sketch.count())).select(*key, "comp"))
    filled = rows.filter("n_shingles > 0").join(large, key, "left")
    few = filled.filter("comp is null").drop("comp").join(named.select(*key, "comp"), key, "left")
    joined = filled.filter("comp is not null").unionByName(few).unionByName(rows.filter("n_shingles = 0").withColumn("comp", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("comp"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
