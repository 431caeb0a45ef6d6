"""What several training-data operators share: shared-folder tables, Arrow
batch helpers, and vectorised byte hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that has a query's shuffle files deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text hashed at once in a Python worker; bounds its memory.
CHUNK_BYTES = 1 << 18

_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).  Only a
    local session may do without: it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """The tables that an operator writes on its way.

    ``put`` writes a DataFrame as Parquet to the shared folder and reads it
    again: lineage is cut, losing an executor loses nothing, and the shuffle files
    of the write are deleted once the table stands.  ``drop`` deletes tables that nothing reads any more.  At the end of the ``with`` block all are
    deleted but those that were kept, which go when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{self.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        where, files = self._path(path)
        files.deleteOnExit(where)
        table = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self.tables.append((table, path))
        return table

    def drop(self, *gone: DataFrame) -> None:
        for path in [p for t, p in self.tables if any(t is g for g in gone)]:
            where, files = self._path(path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)
        self.tables = [(t, p) for t, p in self.tables if not any(t is g for g in gone)]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.tables])


def materialize(df: DataFrame, label: str) -> DataFrame:
    """A table that stays until the session ends."""
    return Scratch(df.sparkSession).put(df, label, keep=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, str]]:
    """(row, text) of a batch, one Python string at a time; null is empty."""
    col = batch.column(column)
    for i in range(len(col)):
        yield i, col[i].as_py() or ""


def slices(batch: pa.RecordBatch, *columns: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch holding about ``limit`` bytes in ``columns``
    (text by default); a longer row comes alone."""
    if not batch.num_rows:
        return
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns or ("text",))
    part = (np.cumsum(size) - size) // limit
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(starts[:-1], starts[1:]):
        yield batch.slice(int(a), int(b - a))


def joined_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch as one byte array, and where each begins (length + 1)."""
    col = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if bufs[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 65536), np.uint64(base))
        out[0] = 1
        have = _POWERS[base] = np.cumprod(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class RollingHash:
    """64-bit polynomial hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray, fold_case: bool = False):
        table = _TABLE[_LOWER] if fold_case else _TABLE
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * _powers(_MULT, n), out=self.sums[1:])
        self.inverse = _powers(_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def of_all(self, size: int) -> np.ndarray:
        """The hashes of all substrings of one size, by their starts."""
        h = self.sums[size:] - self.sums[: len(self.sums) - size]
        h *= self.inverse[: len(h)]
        h += np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFF_FFFFFFFF)
        return mix(h)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ([^\\x20\\x09-\\x0D]+) of joined texts, and
    the number of words before each text (length + 1).  Words end with a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begin[inner] = word[inner]
    finish = word.copy()
    finish[:-1] &= ~word[1:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    finish[last] = word[last]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offsets)


#: What str.split() splits at and the tokenizers do not.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_len(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())
