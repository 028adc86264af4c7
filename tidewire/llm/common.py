"""Shared pieces of the training-data operators: durable intermediates, input shaping, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
#: Spark's own switch: a query's shuffle files are removed when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Folders of local sessions that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as the session names it. Only in a local session that names none, where
    driver and executors are one process, a folder of our own; elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidewire-")
        _own[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


class Tables:
    """Intermediate tables written to the shared folder, so a lost executor costs one table's tasks and not the lineage before it."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/tidewire/{tag}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` from a table of its own. The shuffle files of the write are of no further use and go with its end."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN)
            else:
                self.spark.conf.set(CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing lazy reads any more."""
        jvm, hconf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if "/tidewire/" in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(hconf).delete(path, True)


def released(run):
    """``run`` over Arrow batches, and at its end the worker's unused Arrow memory back to the system: workers outlive tasks."""

    def all_(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return all_


def held_out(doc_id: Column, folds: int) -> Column:
    """True for the fold that training never sees; a row without an id is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


class WordHash(dict):
    """64-bit hashes of words, kept for those met lately. Long words are hashed each time, so memory has a bound."""

    LIMIT, LONGEST = 120_000, 48

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per Python worker: it outlives a task, and holds only pure function values.
WORDS = WordHash()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising step of a 64-bit hash: each input bit reaches each output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out * np.uint64(0x9E3779B97F4A7C15) + p
    return mix(out)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array a row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind))
