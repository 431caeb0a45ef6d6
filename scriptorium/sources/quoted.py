"""Records with line breaks in quoted cells, read by as many tasks as a file has splits.

A split begins at some line, which may lie within a quoted cell.  One pass counts
the quotes of each split; their running sum over a file's splits, few numbers,
tells for each whether it begins inside a cell.  A second pass cuts every split
into records on its own.  Only what reaches over a border, at most a head and a
tail for each split, is put together across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Splits that begin inside a cell, up to which they are sent to every task.
BROADCAST_SPLITS = 100_000

SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines, those of one split in their order within one task."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their number in the file, from 0.  A split
    counts its lines from its own start, and the counts of the splits before it are added."""
    lines = _lines(spark, path).withColumn("at", F.monotonically_increasing_id())  # one after the other within a split
    splits = lines.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("origin"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = splits.withColumn("before", before).drop("n")
    return lines.join(placed, SPLIT).select("file", (F.col("at") - F.col("origin") + F.col("before")).alias("line"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def _starts(lines: DataFrame, quote: str) -> DataFrame:
    """The splits that begin inside a quoted cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    counted = lines.groupBy(*SPLIT).agg((F.sum(quotes) % 2).alias("odd"))
    before = F.sum("odd").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return counted.withColumn("inside", F.coalesce(before % 2, F.lit(0)) == 1).where("inside").select(*SPLIT, "inside")


def _cut(quote: str):
    """Lines of splits to records: kind 0 is the head of a split (the end of a record
    that began before it), 1 a whole record, 2 a tail (a record that does not end in it)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, open_lines, head = None, False, [], False
        done: list[tuple] = []

        def close():
            if now is not None and open_lines:
                done.append((*now, 0 if head else 2, "\n".join(open_lines)))

        for b in batches:
            files, blocks, values = b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist()
            odd = pc.count_substring(b.column("value"), quote).to_numpy(zero_copy_only=False) % 2
            begins = b.column("inside").to_pylist()
            for i in range(b.num_rows):
                if (files[i], blocks[i]) != now:
                    close()
                    now, open_lines = (files[i], blocks[i]), []
                    inside = head = bool(begins[i])
                open_lines.append(values[i])
                inside ^= bool(odd[i])
                if not inside:
                    done.append((*now, 0 if head else 1, "\n".join(open_lines)))
                    open_lines, head = [], False
            yield _batch(done, schema)
            done.clear()
        close()
        yield _batch(done, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def read_records(spark: SparkSession, path: str, quote: str = '"', broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """(file, block, record): the records of quoted text files, each whole, with the
    split in which it begins.

    Lines end with a line feed, a carriage return before it is no part of a record's
    end; a quote within a cell is doubled.  Blank lines between records are left
    out.  A cell that is never closed reaches to the end of its file.
    """
    lines = _lines(spark, path)
    starts = _starts(lines, quote)
    n = starts.limit(broadcast_splits + 1).count()
    if n <= broadcast_splits:  # a broadcast join keeps the order of the lines
        marked = lines.join(F.broadcast(starts), SPLIT, "left")
    else:
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        marked = numbered.join(starts, SPLIT, "left").repartition(*SPLIT).sortWithinPartitions(*SPLIT, "line")
    cut = marked.select(*SPLIT, F.coalesce("inside", F.lit(False)).alias("inside"), "value").mapInArrow(_cut(quote), "file string, block long, kind int, record string")
    whole = cut.where("kind = 1").select(*SPLIT, "record")
    # heads follow the tail that they continue, at most two rows for each split of a file
    order = W.partitionBy("file").orderBy("block", "kind")
    pieces = cut.where("kind <> 1").withColumn("of", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(order))
    piece = F.struct("block", "kind", "record")
    joined = pieces.groupBy("file", "of").agg(F.min(F.when(F.col("kind") == 2, F.col("block"))).alias("block"), F.array_sort(F.collect_list(piece)).alias("p"))
    border = joined.select("file", F.coalesce("block", F.lit(0)).alias("block"), F.array_join(F.transform("p", lambda x: x.record), "\n").alias("record"))
    return whole.unionByName(border).withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def first_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, record): the first record of every file, without its byte order mark;
    a head's cells hold no line break."""
    top = _lines(spark, path).where("block = 0 and value <> '' and value <> '\r'")
    first = top.withColumn("line", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "line").alias("record"))
    return first.withColumn("record", F.regexp_replace("record", "\\A\\x{FEFF}|\\r\\z", ""))


def read_quoted_csv(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """Text columns under the names of ``aliases``, each from the first of its names
    that the file's own head has, null where it has none.  Files may differ in their
    heads; rows that repeat a head are left out."""
    heads = first_records(spark, path)
    width = heads.select(F.max(F.size(F.split("record", ","))).alias("n")).first().n
    if width is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in aliases))
    shape = ", ".join(f"c{k} string" for k in range(width))
    cells = lambda c: F.from_csv(c, F.lit(shape), {"escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(width, 512))})
    listed = lambda c: F.array(*[c[f"c{k}"] for k in range(width)])
    named = heads.select("file", F.transform(listed(cells("record")), lambda x: F.trim(F.coalesce(x, F.lit("")))).alias("names"))
    places = named.select("file", "names", *[F.coalesce(*[F.nullif(F.array_position("names", a), F.lit(0)) for a in names]).alias(c) for c, names in aliases.items()])
    rows = read_records(spark, path, broadcast_splits=broadcast_splits).select("file", listed(cells(F.regexp_replace("record", "\\A\\x{FEFF}", ""))).alias("cells"))
    both = rows.join(places, "file")
    same = F.transform("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return both.where(F.slice(same, 1, F.size("names")) != F.col("names")).select(*[F.try_element_at("cells", F.col(c).cast("int")).alias(c) for c in aliases])
