"""Streams over the driver's tables that need more than one of them, each with the
same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.plans.queries import PARKED, query, table
from scriptorium.sources.readers import CANTO
from scriptorium.streaming import jobs


def order_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a draft: its suppliers are genes, its lines alleles, all of them
    one genotype, and the order itself the one annotation.  What a draft says are the
    same problems that ``order_queue`` meets in tables."""
    line, supplier, k = table(spark, d, "lineitem"), table(spark, d, "supplier"), F.col("o_orderkey")
    gene = (F.col("l_suppkey") + F.when(F.col("l_partkey") % 50 == 0, 1_000_000).otherwise(0)).cast("string")
    allele = (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).cast("string")
    known = supplier.select(F.col("s_suppkey").cast("string").alias("gene"), F.when(F.col("s_acctbal") < 0, " ").otherwise("P00001").alias("uniprot"))
    rows = line.select(F.col("l_orderkey").alias("draft"), gene.alias("gene"), allele.alias("allele")).join(known, "gene", "left")
    parts = rows.groupBy("draft").agg(
        F.collect_set(F.when(F.col("uniprot").isNotNull(), F.struct(F.col("gene").alias("name"), "uniprot"))).alias("genes"),
        F.collect_set(F.struct(F.col("allele").alias("name"), "gene")).alias("alleles"),
    )
    named = F.struct(F.lit("g").alias("name"), F.array_distinct(F.transform("alleles", lambda a: a["name"])).alias("alleles"))
    note = F.struct(
        F.lit("genotype").alias("feature_type"), F.when(k % 11 == 0, "missing").otherwise("g").alias("feature"), (F.col("o_orderpriority") == "1-URGENT").alias("hold"),
        F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 10 == 0, "GO:0000002").otherwise("GO:0000001")).alias("term_id"),
        F.when(k % 4 == 0, "physical_interaction").when(k % 4 == 1, "molecular_function").otherwise("phenotype").alias("annotation_type"), F.when(F.col("o_custkey") % 3 == 0, "Inferred from x").alias("note"),
    )
    both = table(spark, d, "orders").select(k.alias("draft"), F.array(note).alias("annotations")).join(parts, "draft", "left")
    genotypes = F.when(F.col("alleles").isNotNull(), F.array(named))
    said = F.struct("genes", "alleles", genotypes.alias("genotypes"), "annotations")
    return both.select("draft", F.to_json(said).alias("said"))


@query(f"WITH {PARKED} SELECT draft, CASE WHEN reason = '' THEN 'enter' ELSE 'parked' END AS disposition, reason FROM q")
def stream_parking(spark, d):
    """Drafts come as JSON lines; a stream parks their annotations as ``park_items`` does."""
    folder = jobs.work_folder(spark)
    order_drafts(spark, d).write.json(folder)
    came = spark.readStream.schema("draft long, said string").json(folder)
    index = spark.range(1).select(F.lit("GO:0000001").alias("term_id"), F.lit("x").alias("label"), F.lit(False).alias("obsolete"))
    out = jobs.parked(came.select("draft", F.from_json("said", CANTO).alias("canto")), index, ("GO",))
    return jobs.run_to_table(out, "append").select("draft", "disposition", "reason")
