"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that is reachable, for every end of an edge.

    ``edges`` has long columns a and b; rows without either are left out.
    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones.  Each step is
    an aggregation, combined map-side, and an equi-join; the number of edges never
    grows, and each round is a table in the shared folder that replaces the last.
    """

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.max("v")).first()

    e = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        last, e = e, scratch.put(small, "edges")
        scratch.drop(last)
        now = state(e)
        if now == before:
            break
        before = now
    # what is left are stars: every node points to the smallest of its component
    ends = edges.where("a is not null and b is not null").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    out = ends.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    out = scratch.put(out, "components")
    scratch.drop(e)
    return out
