"""Reviews and indexes over whole batches of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Verdicts, most attention first.
TRIAGE = ("needs_human_decision", "scope_uncertain", "partial", "in_scope", "out_of_scope", "unspecified")


def triage_rank(c: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TRIAGE)), F.coalesce(c, F.lit("unspecified")))
    return F.when(at > 0, at - 1).otherwise(len(TRIAGE) - 1).cast("int")


def triage_tally(drafts: DataFrame) -> DataFrame:
    """Drafts (triage) by verdict with its place, the verdicts that none has too;
    unknown verdicts count, last."""
    every = drafts.sparkSession.createDataFrame([(v,) for v in TRIAGE], "triage string")
    n = drafts.select(F.coalesce("triage", F.lit("unspecified")).alias("triage")).groupBy("triage").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "triage", "full").select("triage", triage_rank(F.col("triage")).alias("triage_rank"), F.coalesce("n", F.lit(0)).alias("n"))


def check_signal(checks: Column) -> Column:
    """ok or flagged values of a map of checks."""
    v = F.coalesce(F.map_values(checks), F.array().cast("array<string>"))
    return F.struct(F.size(F.filter(v, lambda x: F.lower(x).startswith("ok"))).alias("n_ok"), F.size(F.filter(v, lambda x: F.upper(x).rlike("^(FLAG|NOT)"))).alias("n_flagged"))


def coverage(vocabulary: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Counts of every value of a vocabulary, those without records too."""
    n = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.select(key).distinct().join(n, key, "left").fillna(0, ["n"]).withColumn("covered", F.col("n") > 0)


def duplicates(names: DataFrame, key: str, exempt: tuple[str, ...] = ()) -> DataFrame:
    return names.where(~F.col(key).isin(*exempt) if exempt else F.lit(True)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def over_word_cap(text: Column, cap: int = 40) -> Column:
    return F.size(F.split(F.trim(text), r"\s+")) > cap


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, status) of two listings (name, digest, n_terms): new, removed,
    unchanged, updated, or rejected where a new one is empty or lost over half."""
    o, n = (x.select("name", F.col("digest").alias(f"{p}_digest"), F.col("n_terms").alias(f"{p}_terms")) for x, p in ((old, "old"), (new, "new")))
    both = o.join(n, "name", "full")
    bad = (F.col("new_terms") == 0) | (F.col("new_terms") * 2 < F.col("old_terms"))
    status = F.when(F.col("new_terms").isNull(), "removed").when(F.coalesce(bad, F.lit(False)), "rejected").when(F.col("old_terms").isNull(), "new").when(F.col("old_digest") == F.col("new_digest"), "unchanged").otherwise("updated")
    return both.select("name", "old_terms", "new_terms", status.alias("status"))


def classify_by_keywords(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first category of which a keyword is in the text."""
    low, out = F.lower(text), F.when(F.lit(False), "")
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, name)
    return out.otherwise(default)


# Words of development and of content sessions, and the categories in order.
DEVELOPMENT = ("setup", "infrastructure", "automation", "pipeline", "system", "architecture", "database", "integration", "migration", "performance", "framework", "tool", "workflow", "documentation", "protocol")
CONTENT = ("curation", "effector", "protein", "literature", "paper", "pmid")
DECISIVE = ("setup", "system", "automation", "infrastructure", "migration", "architecture")
CATEGORIES = [
    ("Infrastructure", ("setup", "initialization", "foundation")),
    ("Automation", ("automation", "pipeline", "workflow")),
    ("Architecture", ("architecture", "migration", "modular")),
    ("Analytics", ("database", "tracking", "analytics")),
    ("Knowledge Management", ("documentation", "protocol", "training")),
]


def session_kind(text: Column) -> Column:
    """(development, category): development if a decisive word is there, or more
    words of development than of content."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)))
    development = (held(DEVELOPMENT) > held(CONTENT)) | (held(DECISIVE) > 0)
    return F.struct(development.alias("development"), classify_by_keywords(low, CATEGORIES, "System Enhancement").alias("category"))


def overridden(base: DataFrame, override: DataFrame, key: str = "vocab") -> DataFrame:
    """The rows of ``override``, and those of ``base`` whose key it does not name."""
    return override.unionByName(base.join(override.select(key).distinct(), key, "left_anti"))


def divergence(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that only one of two listings has, with the side that has them."""
    one = lambda x, flag: x.select(*keys).distinct().withColumn(flag, F.lit(True))
    both = one(base, "_base").join(one(override, "_override"), keys, "full")
    side = F.when(F.col("_override").isNull(), "base_only").when(F.col("_base").isNull(), "override_only")
    return both.select(*keys, side.alias("side")).where("side is not null")


def counts_by_type(rows: DataFrame, column: str) -> DataFrame:
    """How many rows each type has, unnamed ones as ?, most first, with their place."""
    n = rows.groupBy(F.coalesce(column, F.lit("?")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "type")))


def contract_errors(checks: dict[str, Column]) -> Column:
    """The names of all checks that do not hold (a null does not)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items()]))


def only_new(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


# Categories of flags in their order.
FLAGS = ("needs_pmid", "needs_accession", "needs_term_choice", "needs_genotype_modelling", "needs_evidence_code", "scope_question", "completeness_gap", "other")


def review_order(triage: Column, n_flags: Column, name: Column) -> list[Column]:
    """Drafts by verdict, most attention first, then most flags, then name."""
    return [triage_rank(triage), n_flags.desc(), name]


def flag_place(category: Column) -> list[Column]:
    """Known categories in their order, then others by name."""
    at = F.array_position(F.array(*map(F.lit, FLAGS)), category)
    return [F.when(at > 0, at).otherwise(len(FLAGS) + 1), category]


def by_topic(records: DataFrame, first: int | None = None) -> DataFrame:
    """(topic, name, place): each record (name, topics) under every topic it has."""
    rows = records.select(F.explode(F.array_distinct("topics")).alias("topic"), "name")
    out = rows.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy("name")))
    return out if first is None else out.where(F.col("place") <= first)


def snapshot_summary(files: DataFrame, prefix: str) -> DataFrame:
    """``files`` (name, text) with release, n_terms and digest of each: the first twelve
    digits of its text's SHA-256."""
    terms = F.regexp_count("text", F.lit(rf"(?m)^id:\s*{prefix}:"))
    return files.select("name", F.nullif(F.regexp_extract("text", r"(?m)^data-version:\s*(.+?)\s*$", 1), F.lit("")).alias("release"), terms.cast("long").alias("n_terms"), F.substring(F.sha2(F.encode("text", "utf-8"), 256), 1, 12).alias("digest"))


# What a curated record has to say.
RECORD_STATUSES = ("validated", "draft")


def record_errors(types: tuple[str, ...]) -> Column:
    """What is wrong with a record (name, status, topics, type)."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return contract_errors({"name": said("name"), "status": F.col("status").isin(*RECORD_STATUSES), "topics": F.size("topics") > 0, "type": F.col("type").isin(*types)})
