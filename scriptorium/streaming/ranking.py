"""The gap ranking, kept up to date from the ledger as a stream.

The stream's own state is one row for each distinct pair of a gap and a value, in
update mode, so a batch writes the pairs that changed.  Of the gaps that changed,
rows are made anew from their pairs; neither table is ever written as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import ledger
from scriptorium.streaming.keyed import KeyedTable


class GapRanking:
    """Tables of pairs, of gaps, and of the ``top`` gaps below ``path``."""

    def __init__(self, spark: SparkSession, path: str, top: int = 50, buckets: int = 16, fan: int = 8):
        self.spark, self.path, self.top_n = spark, path, top
        empty = spark.createDataFrame([], "ontology string, norm string, kind string, value string, seq long")
        pairs = ledger.gap_pairs(empty)
        self.pairs = KeyedTable(spark, f"{path}/pairs", pairs.schema, [*ledger.GAP, "kind", "value"], "last", ledger.GAP, buckets, fan)
        self.shape = ledger.gaps_of(pairs).schema
        self.gaps = KeyedTable(spark, f"{path}/gaps", self.shape, ledger.GAP, "seen", None, buckets, fan)

    @staticmethod
    def counted(events: DataFrame) -> DataFrame:
        """What the stream keeps; write it in update mode to ``each``."""
        return ledger.gap_pairs(ledger.gap_facts(events))

    def each(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch; a batch that is replayed leaves everything as it was."""
        batch.persist()
        try:
            self.pairs.put(batch, epoch)
            changed = ledger.gaps_of(self.pairs.lookup(batch))
            self.gaps.put(changed, epoch)
            self._keep_top(batch.select(*ledger.GAP).distinct(), epoch)
        finally:
            batch.unpersist()

    def _best(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*ledger.gap_order()).limit(self.top_n)

    def _keep_top(self, changed: DataFrame, epoch: int) -> None:
        """The first gaps of the ranking: those kept before and those that changed.
        If one of the kept ones fell, another may take its place that has not
        changed, so the table of gaps is asked."""
        target = f"{self.path}/top/{epoch}"
        now = self.gaps.lookup(changed)
        before = self.spark.read.schema(self.shape).parquet(f"{self.path}/top/{epoch - 1}") if epoch else self.spark.createDataFrame([], self.shape)
        asked = changed.toDF("_o", "_n")
        same = F.col("ontology").eqNullSafe(F.col("_o")) & F.col("norm").eqNullSafe(F.col("_n"))
        kept = before.join(asked, same, "left_anti")
        # at most ``top`` rows either way: a gap falls by being filed
        fell = before.alias("b").join(now.alias("n"), [F.col(f"b.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ledger.GAP]).where("b.filed is null and n.filed is not null").limit(1).count()
        best = self._best(self.gaps.read() if fell else kept.unionByName(now))
        best.coalesce(1).write.mode("overwrite").parquet(target)  # ``top`` rows

    def ranking(self) -> DataFrame:
        """All columns of ``ledger.gap_rank``, after the last batch."""
        return self.gaps.read()

    def top(self) -> DataFrame:
        n = self.gaps.batches()
        return self.spark.read.schema(self.shape).parquet(f"{self.path}/top/{n - 1}") if n else self.spark.createDataFrame([], self.shape)
