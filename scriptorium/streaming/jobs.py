"""Streaming twins of batch operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from scriptorium.operators import drafts, validation
from scriptorium.streaming.keyed import KeyedTable
from scriptorium.streaming.ranking import GapRanking


def tokens_by_window(turns: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tokens of each session in tumbling or sliding windows; later turns are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return turns.withWatermark("ts", late).groupBy(w.alias("w"), "session").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "session", "tokens", "n")


def tokens_by_session(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return turns.withWatermark("ts", late).groupBy(w.alias("w"), "session").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "session", "tokens", "n")


def validated(ids: DataFrame, index: DataFrame, indexed: tuple[str, ...]) -> DataFrame:
    """Incoming ids against a static index: a stream-static left join."""
    return validation.validate_ids(ids, index, indexed)


def parked(incoming: DataFrame, index: DataFrame, indexed: tuple[str, ...], sections: tuple[str, ...] | None = None) -> DataFrame:
    """``incoming`` drafts (draft, canto) to their annotations, each with disposition
    and reason as ``drafts.queue_items`` gives them, batch or stream.

    A stream cannot chain the joins of that cascade, so it is folded within the
    draft's own row; ids of terms meet the static index in one left join."""
    rows = drafts.folded_annotations(incoming)
    checked = validated(rows.withColumn("input_id", validation.strip(F.coalesce("term_id", F.lit("")))), index, indexed)
    bad = F.when((F.col("input_id") != "") & F.col("existence").isin(*validation.PARKING), F.col("existence"))
    return drafts.with_reasons(checked.withColumn("bad_term", bad).drop("input_id", "prefix", "format_valid", "existence", "label", "ok"), sections)


class _FirstSeen(StatefulProcessor):
    """Remembers that a key came, for ``keep_ms`` or for ever; its first row passes."""

    def __init__(self, schema: StructType, order: str, keep_ms: int | None):
        self.names, self.at, self.keep_ms = schema.names, schema.names.index(order), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", StructType().add("known", "boolean"), self.keep_ms)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        # a batch's rows stream by; only the first by order is held
        first = min(rows, key=lambda r: (r[self.at] is not None, r[self.at]), default=None)
        if first is not None and not self.known.exists():
            self.known.update((True,))
            yield Row(**{c: first[c] for c in self.names})

    def close(self) -> None:
        pass


#: The state store that processors with state of their own need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def first_seen(rows: DataFrame, key: str, order: str, keep_ms: int | None = None) -> DataFrame:
    """The first row of each key, whenever it comes again: a state for each key, in
    the checkpoint, that no watermark ends.  ``keep_ms`` is the time, by the clock,
    after which a key that was taken in counts as new; None keeps it for ever.
    Start the query within ``rocksdb``."""
    mode = "none" if keep_ms is None else "processingTime"
    return rows.groupBy(key).transformWithState(_FirstSeen(rows.schema, order, keep_ms), rows.schema, "append", mode)


def first_seen_lately(rows: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """As ``first_seen``, with keys forgotten once the watermark passes: bounded
    state, for keys that come again soon or never."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-streams-")
    return f"{base}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, and read what it wrote.  In complete
    mode each batch replaces the result."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out"))
        writer.start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_upserts(stream: DataFrame, keys: list[str], order: str, **layout: int) -> DataFrame:
    """Run a stream of keyed changes into a ``KeyedTable``, and read it."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    table = KeyedTable(spark, f"{folder}/table", stream.schema, keys, order, **layout)
    stream.writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(table.put).start().awaitTermination()
    return table.read()


def run_ranking(events: DataFrame, top: int = 50) -> GapRanking:
    """Run a ledger's stream into a ``GapRanking``."""
    spark, folder = events.sparkSession, work_folder(events.sparkSession)
    ranking = GapRanking(spark, f"{folder}/ranking", top)
    writer = ranking.counted(events).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log")
    writer.trigger(availableNow=True).foreachBatch(ranking.each).start().awaitTermination()
    return ranking
