"""A table of keyed rows that takes changes by batch, on any shared file system.

A batch writes its own changes only, as a run of Parquet files in hash buckets.
When ``fan`` runs of a level stand, they are merged into one of the next level, so
over time a change is written again once for each level, a logarithm of the number
of batches, and never together with the whole table.  Which runs are live follows
from the number of batches alone: the digits of that number to the base ``fan``.
A batch that is replayed writes the same runs again.  Readers merge the live runs;
a key's row of the newest run counts, and within a batch the last by ``order``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class KeyedTable:
    """``keys`` name a row; ``by``, some of them, decide its bucket, so that rows
    which are looked up together lie together."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str, by: list[str] | None = None, buckets: int = 16, fan: int = 8):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path, schema, keys, order
        self.by, self.buckets, self.fan = by or keys, buckets, fan

    # ---- runs

    def _run(self, level: int, index: int) -> str:
        return f"{self.path}/runs/{level}-{index}"

    def live_runs(self, batches: int) -> list[tuple[int, int]]:
        """(level, index) of the runs that hold the first ``batches``, oldest first."""
        out, level, rest = [], 0, batches
        while rest:
            rest, digit = divmod(rest, self.fan)
            out = [(level, rest * self.fan + k) for k in range(digit)] + out
            level += 1
        return out

    def _merged_at(self, batches: int) -> list[tuple[int, int]]:
        """The runs that the merges after that many batches made needless."""
        out, level = [], 1
        while batches and batches % self.fan**level == 0:
            first = batches // self.fan ** (level - 1) - self.fan
            out += [(level - 1, first + k) for k in range(self.fan)]
            level += 1
        return out

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self, rows: DataFrame, newest: str | None = None) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        rank = F.struct(*([newest] if newest else []), self.order)
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in self.schema.names])

    def _write(self, rows: DataFrame, level: int, index: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
        rows.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self._run(level, index))

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        """All rows of runs, with their age: greater is newer."""
        schema = StructType(list(self.schema.fields)).add(BUCKET, "integer")
        out = self.spark.createDataFrame([], schema).withColumn("_age", F.lit(0))
        for age, run in enumerate(runs, 1):
            part = self.spark.read.schema(schema).parquet(self._run(*run)).withColumn("_age", F.lit(age))
            out = part if age == 1 else out.unionByName(part)
        return out

    # ---- changes

    def put(self, batch: DataFrame, epoch: int) -> None:
        """The changes of batch ``epoch``, counted from 0 without gaps (for foreachBatch)."""
        n = epoch + 1
        for gone in self._merged_at(epoch):  # a replay of this batch needs none of them
            where, files = self._files(self._run(*gone))
            files.delete(where, True)
        self._write(self._latest(batch.select(*self.schema.names)), 0, epoch)
        level = 1
        while n % self.fan**level == 0:
            index = n // self.fan**level - 1
            parts = [(level - 1, index * self.fan + k) for k in range(self.fan)]
            self._write(self._latest(self._read(parts), "_age"), level, index)
            level += 1
        where, files = self._files(f"{self.path}/batches/{epoch}")
        files.create(where, True).close()
        old, files = self._files(f"{self.path}/batches/{epoch - 2}")
        files.delete(old, False)

    def batches(self) -> int:
        """How many batches stand complete."""
        where, files = self._files(f"{self.path}/batches")
        if not files.exists(where):
            return 0
        return 1 + max((int(s.getPath().getName()) for s in files.listStatus(where)), default=-1)

    # ---- reading

    def read(self) -> DataFrame:
        """Every key's row."""
        return self._latest(self._read(self.live_runs(self.batches())), "_age")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose ``by`` columns ``wanted`` has; only their buckets are read."""
        wanted = wanted.select(*self.by).distinct()
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
        hit = [r[0] for r in wanted.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        rows = self._read(self.live_runs(self.batches())).where(F.col(BUCKET).isin(hit))
        asked = wanted.toDF(*[f"_{c}" for c in self.by])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.by]
        return self._latest(rows.join(asked, same, "left_semi"), "_age")
