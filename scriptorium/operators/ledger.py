"""The ledger of vocabulary gaps: validation, and what is missed most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scriptorium.functions.text import normal_phrase, text_or_empty

# What an event can say.
OUTCOMES = ("gap", "synonym")


def checked_events(events: DataFrame, ontologies: tuple[str, ...]) -> DataFrame:
    """``events`` with ``rejected``: the first invariant that fails, or null."""
    term = text_or_empty(F.col("matched_term"))
    reason = (
        F.when(~F.coalesce(F.upper("ontology"), F.lit("")).isin(*ontologies), "unknown ontology")
        .when(~F.coalesce(F.col("outcome"), F.lit("")).isin(*OUTCOMES), "unknown outcome")
        .when(text_or_empty(F.col("phrase")) == "", "empty phrase")
        .when((F.col("outcome") == "synonym") & (term == ""), "synonym without term")
        .when((F.col("outcome") == "gap") & (term != ""), "gap with a term")
    )
    return events.withColumn("rejected", reason)


#: What is kept of a gap's events: the events themselves, and the distinct values of four columns.
KINDS = {"seen": None, "paper": "pmid", "variant": "phrase", "context": "context", "filed": "filed"}
GAP = ["ontology", "norm"]


def gap_facts(events: DataFrame) -> DataFrame:
    """(ontology, norm, kind, value, seq): a row for each thing that a gap event says."""
    gaps = events.where("outcome = 'gap'").withColumn("norm", normal_phrase(F.col("phrase")))
    said = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(c) if c else F.lit(None)).cast("string").alias("value")) for k, c in KINDS.items()])
    each = gaps.select(*GAP, "seq", F.explode(said).alias("s")).select(*GAP, "s.kind", "s.value", "seq")
    return each.where("kind = 'seen' or value is not null")


def gap_pairs(facts: DataFrame) -> DataFrame:
    """(ontology, norm, kind, value, n, first, last): how often, and from where to
    where in the ledger, a gap said a value.  A phrase that a third of all events
    repeat is as many rows as it has distinct papers, wordings and contexts."""
    return facts.groupBy(*GAP, "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def gaps_of(pairs: DataFrame) -> DataFrame:
    """One row per gap from its pairs, lists in ledger order."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c) if isinstance(c, str) else c)
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(of(kind, F.struct("first", "value")))), lambda x: x.value)
    out = pairs.groupBy(*GAP).agg(
        F.sum(of("seen", "n")).alias("seen"), F.max_by("value", of("variant", "last")).alias("phrase"), F.max_by("value", of("filed", "last")).alias("filed"),
        listed("paper").alias("papers"), listed("variant").alias("variants"), listed("context").alias("contexts"),
    )
    return out.withColumns({f"n_{c}": F.size(c).cast("long") for c in ("papers", "variants", "contexts")})


def gap_rank(events: DataFrame) -> DataFrame:
    """Genuine gaps by how many papers needed the term; unfiled ones first.

    ``events``: seq, ontology, phrase, outcome, pmid, context, filed.  Wordings
    and papers are made distinct before they are gathered.
    """
    return gaps_of(gap_pairs(gap_facts(events)))


def gap_order() -> list[Column]:
    return [F.col("filed").isNotNull(), F.desc("n_papers"), F.desc("seen"), F.col("norm"), F.col("ontology")]


def synonym_rank(events: DataFrame) -> DataFrame:
    """Terms that were there but missed, by the number of wordings that missed them."""
    missed = events.where("outcome = 'synonym' and matched_term is not null and matched_term <> ''")
    return missed.groupBy("ontology", "matched_term").agg(F.countDistinct("phrase").alias("n_missed"), F.countDistinct("pmid").alias("n_papers"))


def ranked(found: DataFrame, order: list[Column], first: int) -> DataFrame:
    """The first rows of a ranking, with their place."""
    return found.orderBy(*order).limit(first).withColumn("place", F.row_number().over(W.orderBy(*order)))


def synonym_order() -> list[Column]:
    return [F.desc("n_missed"), F.col("matched_term"), F.col("ontology")]
