"""The corpus pipeline: quality rules, near and exact duplicates, mixing, packing.

Each stage takes the documents that its predecessor kept, whole.  In all stages
a null text counts as the empty one, which the quality rules reject; a row
without doc_id is compared with nothing, and is mixed and packed like any other;
rows that repeat a doc_id are one document and stay or go together; texts of any
length are taken whole by every stage; of equal texts, and of equal passages, the
smallest doc_id keeps its own; an empty table gives an empty result; columns that
``documents`` does not have are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm import mixing, near_dup, packing, quality_rules, suffix_dedup
from scriptorium.llm.common import Scratch, read
from scriptorium.llm.queries import BYTE_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; their bands are learned from labels."""
    docs = docs.select(*COLUMNS)
    return quality_rules.keep_good(docs, quality_rules.fit_bands(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    gone = near_dup.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document has go from the texts, letters whole;
    documents of which no word is left go."""
    left = suffix_dedup.without_repeats(docs.select(*COLUMNS), carry=("lang", "source"), as_text=True)
    left = left.select("doc_id", F.col("kept").alias("text"), "lang", "source")
    return left.where(r"text rlike '[^\\x20\\x09-\\x0D]'").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole repeats, and once more
    where part of a further repeat is taken.  Those taken no word of go.  Rows of a
    source that share a doc_id, or have none, are taken as often as the most taken
    of them."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix_sources(docs).select("doc_id", "source", "size", "taken")
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    plan = taken.groupBy("doc_id", "source").agg(F.max(times).alias("times")).where("times > 0")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source"))
    both = docs.alias("d").join(plan.alias("p"), same).select("d.*", "p.times")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each with its sequence and place."""
    return packing.best_fit_pack(docs, BYTE_BPE)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("suffix-array dedup", suffixes), ("mixing", mix), ("packing", pack)]

#: Compression, sketches, tokenizers: SQL cannot express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES):
            before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=k == len(STAGES) - 1)
            scratch.drop(before)
    return docs
