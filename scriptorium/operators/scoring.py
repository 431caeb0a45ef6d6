"""Drafts against gold, and score sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.shares import dealt


def overlap(pred: DataFrame, gold: DataFrame, keys: list[str], item: str, shares: int | None = None) -> DataFrame:
    """(keys, item, in_pred, in_gold): a full join of two sets of rows."""
    p = dealt(pred.select(*keys, item), shares, *keys, item).distinct().withColumn("in_pred", F.lit(True))
    g = dealt(gold.select(*keys, item), shares, *keys, item).distinct().withColumn("in_gold", F.lit(True))
    both = p.join(g, [*keys, item], "full")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_pred", "in_gold")})


def overlap_scores(both: DataFrame, keys: list[str], item: str) -> DataFrame:
    """tp, precision, recall and F1 by ``keys``, 0 where undefined, and what was
    missed or spurious."""
    hit, p, g = F.col("in_pred") & F.col("in_gold"), F.col("in_pred"), F.col("in_gold")
    by = both.groupBy(*keys).agg(
        F.count_if(hit).alias("tp"), F.count_if(p).alias("n_pred"), F.count_if(g).alias("n_gold"),
        F.array_sort(F.collect_list(F.when(~p, F.col(item)))).alias("missed"), F.array_sort(F.collect_list(F.when(~g, F.col(item)))).alias("spurious"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = by.withColumns({"precision": share(F.col("tp"), F.col("n_pred")), "recall": share(F.col("tp"), F.col("n_gold"))})
    return by.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def points(rating: Column) -> Column:
    """Correct 1, needs improvement a half, incorrect 0; else null."""
    r = F.lower(F.trim(rating))
    return F.when(r == "correct", 1.0).when(r == "needs improvement", 0.5).when(r == "incorrect", 0.0)


def long_scores(sheet: DataFrame, ids: list[str]) -> DataFrame:
    """A sheet of any item columns as (ids, item, rating)."""
    items = [c for c in sheet.columns if c not in ids]
    return sheet.unpivot(ids, items, "item", "rating")


def paper_scores(ratings: DataFrame) -> DataFrame:
    """Per paper (paper, group, curatable, captured, rating): accuracy over the
    items that apply, and completeness, null without anything to curate."""
    by = ratings.groupBy("paper", "group").agg(F.avg(points(F.col("rating"))).alias("accuracy"), F.max("curatable").alias("curatable"), F.max("captured").alias("captured"))
    return by.withColumn("completeness", F.try_divide(F.col("captured"), F.col("curatable"))).drop("curatable", "captured")


def item_accuracy(ratings: DataFrame) -> DataFrame:
    """By item, by group, and over all."""
    sets = ratings.groupingSets([["item"], ["group"], []], "item", "group")
    return sets.agg(F.avg(points(F.col("rating"))).alias("accuracy"), F.count(points(F.col("rating"))).alias("n_rated"))


def group_scores(papers: DataFrame) -> DataFrame:
    """Means of papers' scores, each paper counting once."""
    return papers.groupBy("group").agg(F.count(F.lit(1)).alias("n_papers"), F.avg("accuracy").alias("accuracy"), F.avg("completeness").alias("completeness"))


def sheet_totals(ratings: DataFrame) -> DataFrame:
    """Per group: papers, tokens (each paper's once) and the models, in order."""
    papers = ratings.groupBy("paper", "group").agg(F.max("tokens").alias("tokens"), F.max("model").alias("model"))
    return papers.groupBy("group").agg(F.count(F.lit(1)).alias("n_papers"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("model")).alias("models"))
