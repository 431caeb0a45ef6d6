"""Progress of curation over articles, sessions, proteins and mentions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scriptorium.functions.text import text_or_empty
from scriptorium.operators.validation import figures_available, source_route

# Statuses by order of work, and those that count as complete.
STATUSES = ("queued", "in_progress", "curated", "reviewed", "published")
COMPLETE = STATUSES[2:]


def progress(sessions: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Per day and curator over the last ``days``."""
    recent = sessions.where(F.to_date("session_date") >= F.date_sub(F.lit(as_of), days))
    return recent.groupBy(F.to_date("session_date").alias("day"), "curator").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("proteins").alias("proteins"), F.sum("interactions").alias("interactions"), F.sum("hours").alias("hours"))


def status_counts(articles: DataFrame, mentions: DataFrame, distinct: bool = False) -> DataFrame:
    """Articles by status.  As defined, an article counts once for each mention
    it has; ``distinct`` counts it once."""
    both = articles.select("article_id", "status").join(mentions.select("article_id", "protein_id"), "article_id", "left")
    n = F.countDistinct("article_id") if distinct else F.count("article_id")
    return both.groupBy("status").agg(n.alias("n_articles"), F.countDistinct("protein_id").alias("n_proteins"))


def completion(articles: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sums of sessions of each completed article, 0 without any."""
    sums = sessions.groupBy("article_id").agg(F.sum("proteins").alias("proteins"), F.sum("interactions").alias("interactions"))
    out = articles.where(F.col("status").isin(*COMPLETE)).select("article_id", "status").join(sums, "article_id", "left")
    return out.fillna(0, ["proteins", "interactions"])


def workload(articles: DataFrame) -> DataFrame:
    return articles.groupBy("curator").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "in_progress").alias("active"))


def by_route(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_route").agg(F.count(F.lit(1)).alias("n"))


def effectors(proteins: DataFrame, species: DataFrame, like: str | None = None) -> DataFrame:
    out = proteins.where("protein_type = 'effector'").join(species, "species_id")
    return out if like is None else out.where(F.col("species_name").like(like))


def unread_figures(articles: DataFrame) -> DataFrame:
    """Articles with captions only, or with figures that nobody read."""
    captions = F.col("figures_available") == 0
    unread = F.coalesce("figures_inspected", F.lit(0)) < F.col("figures_total")
    return articles.where(captions | unread).withColumn("why", F.when(captions, "captions only").otherwise("figures unread"))


def latest(rows: DataFrame, keys: list[str], when: str, tie: str, n: int = 1) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(when), F.desc(tie)))).where(F.col("place") <= n)


def match_article(rows: DataFrame, articles: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with article_id: by the first of ``keys`` that finds one, the
    smallest if several do.  Empty values match nothing."""
    out = rows
    for k in keys:
        by = articles.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "").groupBy(k).agg(F.min("article_id").alias(f"by_{k}"))
        out = out.join(by, k, "left")
    return out.withColumn("article_id", F.coalesce(*[f"by_{k}" for k in keys])).drop(*[f"by_{k}" for k in keys])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after keyed changes: a key's last change replaces its row."""
    every = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return every.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def with_citation(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """``rows`` (pmid, title, first_author, year) with what ``articles`` (pmid, title,
    authors, pub_year) knows; where it knows nothing, their own stay."""
    a = articles.groupBy("pmid").agg(F.min(F.struct(F.col("title").alias("t"), F.trim(F.coalesce("authors", F.lit(""))).alias("authors"), F.col("pub_year").cast("string").alias("y"))).alias("_a"))
    out = rows.join(a, "pmid", "left")
    first = F.nullif(F.regexp_extract("_a.authors", "^[^ ,]*", 0), F.lit(""))
    known = F.col("_a").isNotNull()
    return out.withColumns({"title": F.coalesce(F.nullif(F.col("_a.t"), F.lit("")), "title"), "first_author": F.coalesce(first, "first_author"), "year": F.when(known, F.trim(F.coalesce("_a.y", F.lit("")))).otherwise(F.col("year"))}).drop("_a")


def set_status(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """``articles`` with the last status (article_id, status, seq) that a change names,
    of equal places the greater name.
    Changes to others, or to a status that does not exist, do nothing."""
    last = changes.where(F.col("status").isin(*STATUSES)).groupBy("article_id").agg(F.max(F.struct("seq", "status"))["status"].alias("_to"))
    return articles.join(last, "article_id", "left").withColumn("status", F.coalesce("_to", "status")).drop("_to").select(*articles.columns)


def record_completion(articles: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles and sessions after completed curations.

    ``articles``: article_id, pmid, note_path, title, status; ``done``: pmid,
    note_path, title, and what a session records.  An article is found by pmid,
    else note path, else title, and becomes curated.  Where none is found, one is
    added for each paper; its id is a hash of the first of the three it has, so
    that no counter passes through one task.  Every row of ``done`` is a session
    with the article's id and whether it was created.
    """
    keys = ("pmid", "note_path", "title")
    met = match_article(done, articles, list(keys))
    name = F.coalesce(*[F.nullif(F.trim(k), F.lit("")) for k in keys])
    met = met.withColumn("created", F.col("article_id").isNull())
    # below every id that counts from 0
    met = met.withColumn("article_id", F.coalesce("article_id", -1 - F.shiftrightunsigned(F.xxhash64(name), 1)))
    fresh = met.where("created").groupBy("article_id").agg(*[F.min(k).alias(k) for k in keys]).withColumn("status", F.lit("curated"))
    changed = met.where("not created").select("article_id", F.lit("curated").alias("status"), F.lit(0).alias("seq"))
    after = set_status(articles, changed).unionByName(fresh, allowMissingColumns=True)
    return after, met


# Relations of the tracking store, the values that some columns allow, what is unique, and the order of statuses on lists.
RELATIONS = {
    "species": "id long, name string, type string, taxonomy_id string, common_name string, notes string",
    "articles": "id long, pmid string, doi string, title string, journal string, pub_year int, authors string, status string, curator string, priority string, obsidian_note_path string, source_route string, source_file string, figures_available int, figures_inspected int, figures_total int",
    "proteins": "id long, gene_id string, uniprot_id string, species_id long, name string, gene_name string, function_summary string, protein_type string",
    "curation_sessions": "id long, session_date date, curator string, article_id long, session_duration_hours double, proteins_curated int, interactions_added int, experiments_annotated int, notes string",
    "protein_article_mentions": "id long, protein_id long, article_id long, mention_context string, experimental_evidence string, curated int",
}
ALLOWED = {
    "species": {"type": ("host", "pathogen")},
    "articles": {"status": STATUSES, "priority": ("low", "medium", "high")},
    "proteins": {"protein_type": ("effector", "resistance", "virulence", "other")},
    "protein_article_mentions": {"experimental_evidence": ("complementation", "knockout", "overexpression", "biochemical", "other")},
}
UNIQUE = {"articles": (("pmid",),), "protein_article_mentions": (("protein_id", "article_id"),)}
REQUIRED = {"species": ("name", "type"), "articles": ("title",), "curation_sessions": ("session_date", "curator")}
REFERS = {
    "proteins": {"species_id": "species"},
    "curation_sessions": {"article_id": "articles"},
    "protein_article_mentions": {"protein_id": "proteins", "article_id": "articles"},
}
LISTED = ("in_progress", "queued", "curated", "reviewed", "published")


def relation_errors(name: str, rows: DataFrame, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """(relation, problem, n) of a relation's rows: a row for each of its rules, with
    how many rows break it.  Columns that must say something, values that a column
    does not allow, further rows of a key that is unique, and, where the relation
    referred to is among ``others`` (with its id), references that lead nowhere.
    Nulls are allowed but where something must be said."""
    rules = {f"{c} missing": F.col(c).isNull() for c in REQUIRED.get(name, ())}
    rules |= {f"{c} not allowed": ~F.col(c).isin(*values) for c, values in ALLOWED.get(name, {}).items()}
    found = rows.sparkSession.createDataFrame([], "problem string, n long")
    if rules:  # one pass over the rows
        counted = rows.agg(*[F.count_if(rule).alias(problem) for problem, rule in rules.items()])
        found = found.unionByName(counted.unpivot([], list(rules), "problem", "n"))
    for keys in UNIQUE.get(name, ()):
        by = rows.dropna(subset=list(keys)).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("m"))
        found = found.unionByName(by.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).select(F.lit(f"{', '.join(keys)} repeated").alias("problem"), "n"))
    for column, other in REFERS.get(name, {}).items():
        if others and other in others:
            there = others[other].select(F.col("id").alias(column)).distinct()
            lost = rows.select(column).dropna().join(there, column, "left_anti")
            found = found.unionByName(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{column} leads nowhere").alias("problem"), "n"))
    return found.select(F.lit(name).alias("relation"), "problem", "n")


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table after inserts, each row with its disposition: there, inserted, or
    rejected: of a key that the table has, or that an earlier row (seq, which tells
    rows apart) has taken."""
    held = table.select(*keys).dropna().distinct().withColumn("_held", F.lit(True))
    # the least seq of a key takes it; rows without a whole key are never compared
    first = rows.dropna(subset=keys).groupBy(*keys).agg(F.min("seq").alias("_first"))
    met = rows.join(held, keys, "left").join(first, keys, "left")
    taken = F.col("_held").isNotNull() | (F.col("_first") < F.col("seq"))
    new = met.withColumn("disposition", F.when(F.coalesce(taken, F.lit(False)), "rejected").otherwise("inserted")).drop("_held", "_first", "seq")
    return table.withColumn("disposition", F.lit("there")).unionByName(new, allowMissingColumns=True)


def attach_provenance(articles: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles with what conversion reports say of their source, and the reports with
    the article that each was attached to; one that finds none creates none.

    ``reports``: seq, pmid, note_path, title, route, source_file, inspected (whether
    figures were), figures_read, figures_total; an article's last report counts.
    """
    met = match_article(reports, articles, ["pmid", "note_path", "title"])
    last = met.where("article_id is not null").groupBy("article_id").agg(F.max_by(F.struct("route", "source_file", "inspected", "figures_read", "figures_total"), "seq").alias("r"))
    route = source_route(F.col("r.route"), F.lit(""))
    there = F.col("r").isNotNull()
    new = {
        "source_route": route, "source_file": F.nullif(text_or_empty(F.col("r.source_file")), F.lit("")), "figures_available": F.when(route.isNotNull(), figures_available(F.col("r.route"), F.col("r.inspected")).cast("int")),
        "figures_inspected": F.col("r.figures_read"), "figures_total": F.col("r.figures_total"),
    }
    out = articles.join(last, "article_id", "left")
    out = out.withColumns({c: F.when(there, v).otherwise(F.col(c) if c in articles.columns else F.lit(None)) for c, v in new.items()}).drop("r")
    return out, met.withColumn("status", F.when(F.col("article_id").isNull(), "no article").otherwise("attached"))


def list_order(status: str = "status") -> Column:
    """The place of a status on lists, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, LISTED)), F.col(status))
    return F.when(at > 0, at).otherwise(len(LISTED) + 1).cast("int")


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of a total order, with their place."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))


def article_listing(articles: DataFrame, mentions: DataFrame, proteins: DataFrame) -> DataFrame:
    """Articles with their mentions counted and the proteins' names listed, by
    their sort keys: status as on lists, priority as text and year, both falling."""
    named = mentions.select("article_id", "protein_id").join(proteins.select("protein_id", "gene_name"), "protein_id", "left")
    by = named.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.array_join(F.array_sort(F.collect_list("gene_name")), ", ").alias("proteins"))
    return articles.join(by, "article_id", "left").fillna(0, ["n_mentions"]).withColumn("status_place", list_order())


def listing_order() -> list[Column]:
    return [F.col("status_place"), F.desc("priority"), F.desc("pub_year"), F.col("article_id")]


def mention_details(mentions: DataFrame, proteins: DataFrame, articles: DataFrame) -> DataFrame:
    """Mentions with their protein's name and their article's title, and what is missing."""
    out = mentions.join(proteins.select("protein_id", "gene_name"), "protein_id", "left").join(articles.select("article_id", "title"), "article_id", "left")
    return out.withColumn("missing", F.concat_ws(", ", F.when(F.col("gene_name").isNull(), "protein"), F.when(F.col("title").isNull(), "article")))


def period_totals(sessions: DataFrame, as_of: dt.date, periods: dict[str, int]) -> DataFrame:
    """(period, n_sessions, and sums) over the last days of each period, today being
    ``as_of`` and 0 days; a period without sessions has zeros."""
    day = F.to_date("session_date")
    names = F.array(*[F.struct(F.lit(k).alias("period"), F.lit(n).alias("days")) for k, n in periods.items()])
    held = F.filter(names, lambda p: day >= F.date_sub(F.lit(as_of), p.days))
    sums = sessions.where(day.isNotNull()).select(F.explode(held).alias("p"), "proteins", "interactions", "hours").groupBy("p.period").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("proteins").alias("proteins"), F.sum("interactions").alias("interactions"), F.sum("hours").alias("hours"))
    every = sessions.sparkSession.range(1).select(F.explode(names).alias("p")).select("p.period")
    return every.join(sums, "period", "left").fillna(0)


def status_totals(articles: DataFrame) -> DataFrame:
    return articles.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("place", list_order())


def data_gaps(articles: DataFrame, proteins: DataFrame) -> DataFrame:
    """(kind, id): proteins without an accession, queued articles without a curator,
    and articles that want attention, queued or in progress."""
    gap = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"))
    bare = proteins.where(text_or_empty(F.col("uniprot_id")) == "")
    waiting = articles.where("status = 'queued' and curator is null")
    return gap(bare, "no accession", "protein_id").unionByName(gap(waiting, "no curator", "article_id")).unionByName(gap(articles.where("status in ('queued', 'in_progress')"), "attention", "article_id"))
