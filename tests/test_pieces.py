"""What is held at once does not grow with the input."""

import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.functions.batches import pieces
from scriptorium.llm import media
from scriptorium.operators import documents
from scriptorium.sources import articles


def test_pieces_are_bounded_and_whole():
    texts = ["x" * (k % 7) for k in range(100)] + [None, "y" * 50, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
    got = list(pieces(batch, "text", limit=20))
    assert [x for b in got for x in b.column("text").to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column("text").to_pylist()) <= 20 for b in got)
    assert len(got) > 15 and list(pieces(batch.slice(0, 0), "text")) == []


def test_python_steps_parse_in_pieces(spark, monkeypatch):
    """Each step that parses texts in Python takes a batch piece by piece: what it
    yields at once comes of a piece, though the rows come in one batch."""
    line = "Figure 1. " + "cells at work " * 60 + "\n\n"
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc"), F.lit(line * 5).alias("text"))
    xml = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc"), F.lit("<article><body><sec><p>" + "x" * 5000 + "</p></sec></body></article>").alias("xml"))
    yielded = []

    def held(self, fn, schema, *_):
        cols = self.toArrow().to_batches()
        yielded.append([b.num_rows for b in fn(iter(cols))])
        return self

    monkeypatch.setattr(type(docs), "mapInArrow", held)
    documents.captions(docs)
    articles.article_table(xml, "sections")
    assert [sum(x) for x in yielded] == [2000, 400]
    assert all(len(x) > 2 and max(x) < sum(x) / 2 for x in yielded)


def test_caption_of_a_page_number_and_notes():
    assert documents.clean_caption("- Cells at work  12 ") == "Cells at work"
    assert documents.clean_caption("Cells (color online) at (see text)") == "Cells at"
    assert documents.clean_caption("Cells (a) 3 (Color online)") == "Cells (a) 3"


def test_text_items_are_dealt_over_tasks(spark):
    """Items without a reference have no key; they do not meet in one task."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("<p>a</p><p>b</p>").alias("html"))
        facts = spark.sql("select 'd' as digest, 1L as n_bytes")
        out = media.resolve(media.interleave(pages), "page_id", facts)
        rows = out.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in rows) == 800 and max(r["count"] for r in rows) < 400
        assert out.where("resolved or ref is not null").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
