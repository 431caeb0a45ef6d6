"""Phrases to vocabulary terms: inverse document frequencies, scores, ranking.

Candidates come from an equi-join on tokens instead of comparing all pairs, and
of a phrase's tokens only those take part that no match can do without.  Scores
are those of distinct texts; each text stands for the few first of its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scriptorium.functions.text import strip, tokens

# Subsets that decide what a term may be used for, and the least score of a match.
NOT_ANNOTATABLE = ("qc_do_not_annotate", "qc_do_not_manually_annotate", "gocheck_do_not_annotate", "gocheck_do_not_manually_annotate", "canto_root_subset")
EXTENSION_ONLY = ("qc_extension_only",)
LEAST_SCORE = 20.0
CONTEXTS = ("in-host", "free-living")


def usage_of(subsets: Column) -> Column:
    s = F.coalesce(subsets, F.array().cast("array<string>"))
    among = lambda names: F.arrays_overlap(s, F.array(*map(F.lit, names)))
    return F.when(among(NOT_ANNOTATABLE), "grouping").when(among(EXTENSION_ONLY), "extension_only").otherwise("primary")


def term_texts(terms: DataFrame) -> DataFrame:
    """(term_id, text): name and synonyms of terms (term_id, name, synonyms, ...)."""
    return terms.select("term_id", F.explode(F.array_union(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("text"))


def idf(texts: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(terms / df); a token counts once per term."""
    n = texts.select("term_id").distinct().count()
    posted = texts.select("term_id", F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(F.lit(float(max(n, 1))) / F.col("df")))


def weighed(phrases: DataFrame, weights: DataFrame) -> DataFrame:
    """(phrase_id, q, mass, parts, key): of each phrase its lower-cased text, the
    mass of its tokens, these with their weights, and the tokens to look texts up by.

    A text that reaches a third of the mass has one of the heaviest tokens, up to
    where the rest holds less than a third.  A text that holds the whole phrase has
    the tokens between its first and last one whole, so the heaviest of these is
    looked up besides; of a phrase of two tokens, the end of one and the start of
    the next stand side by side in the text, and that boundary is looked up.
    """
    rarest = weights.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("rarest"))
    said = F.regexp_extract_all(F.col("q"), F.lit("[a-z0-9]+"), 0)
    q = phrases.select("phrase_id", F.lower(strip(F.col("phrase"))).alias("q")).withColumn("said", said)
    each = q.select("phrase_id", "q", "said", F.explode(F.array_distinct("said")).alias("token"))
    each = each.join(weights.select("token", "idf"), "token", "left").crossJoin(F.broadcast(rarest)).withColumn("w", F.coalesce("idf", "rarest"))  # one row
    whole = each.groupBy("phrase_id", "q", "said").agg(F.sum("w").alias("mass"), F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("late"), "token", "w"))).alias("parts")).where("mass > 0")
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("keys"))
    # tokens are taken while those from this one on hold a third or more, with a hair of slack
    step = lambda acc, x: F.struct((acc.sum + x.w).alias("sum"), F.when(F.col("mass") - acc.sum >= F.col("mass") / 3 - 1e-6, F.concat(acc.keys, F.array(x.token))).otherwise(acc.keys).alias("keys"))
    heavy = F.aggregate("parts", start, step, lambda acc: acc["keys"])
    inner = F.slice("said", 2, F.greatest(F.size("said") - 2, F.lit(0)))
    best = F.slice(F.filter(F.transform("parts", lambda x: x.token), lambda t: F.array_contains(inner, t)), 1, 1)
    first, last = F.element_at("said", 1), F.element_at("said", -1)
    seam = F.concat(F.right(first, F.lit(SEAM)), F.lit(" "), F.left(last, F.lit(SEAM)))
    keys = F.array_distinct(F.concat(heavy, best, F.when(F.size("said") == 2, F.array(seam)).otherwise(F.array().cast("array<string>"))))
    return whole.withColumn("key", F.explode(keys)).drop("said")


#: Letters on each side of a boundary between tokens that are looked up.
SEAM = 3


def seams(said: Column) -> Column:
    """Ends and starts of up to ``SEAM`` letters, of all lengths, where two of the
    tokens ``said`` meet.  No token holds the space between them."""
    pairs = F.zip_with(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def seam(i: int, j: int) -> Column:
        return F.transform(pairs, lambda p: F.concat(F.right(p.a, F.lit(i)), F.lit(" "), F.left(p.b, F.lit(j))))

    lengths = range(1, SEAM + 1)
    return F.array_distinct(F.concat(*[seam(i, j) for i in lengths for j in lengths]))


def candidates(weighed_phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of a phrase and a distinct text that can match at all, each once: an
    equi-join on the tokens and boundaries that no match can do without."""
    t = texts.select(F.lower(strip(F.col("text"))).alias("text")).distinct()
    said = F.regexp_extract_all("text", F.lit("[a-z0-9]+"), 0)
    keyed = t.withColumns({"has": tokens(F.col("text")), "key": F.explode(F.concat(F.array_distinct(said), seams(said)))})
    return weighed_phrases.join(keyed, "key").drop("key").dropDuplicates(["phrase_id", "text"])


def scores(phrases: DataFrame, texts: DataFrame, weights: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(phrase_id, text, exact, score) of all pairs of a phrase and a distinct text,
    lower-cased, that reach ``least`` (a third of 60, or more).

    100 for an equal text; 60 times the covered share of the phrase's mass; at
    least 60 and the number of shared tokens if the phrase lies within the text and
    shares one.
    A phrase whose tokens all have no mass scores 0, even if equal.  Tokens that
    no term has weigh as much as the rarest.
    """
    if least < LEAST_SCORE:
        raise ValueError("candidates are complete from a third of the greatest coverage on")
    q = weighed(phrases, weights)
    met = candidates(q, texts)
    shared = F.filter("parts", lambda x: F.array_contains("has", x.token))
    sum_ = F.aggregate(shared, F.lit(0.0), lambda acc, x: acc + x.w)
    covered = 60.0 * sum_ / F.col("mass")
    exact = F.col("text") == F.col("q")
    score = F.when(exact, 100.0).when(F.instr(F.col("text"), F.col("q")) > 0, F.greatest(covered, 60.0 + F.size(shared))).otherwise(covered)
    # summed in floating point: compared with a hair of slack
    return met.where(F.size(shared) > 0).select("phrase_id", "text", exact.alias("exact"), score.alias("score")).where(F.col("score") >= least - 1e-9)


def match_terms(phrases: DataFrame, terms: DataFrame, rows: int = 5, least: float = LEAST_SCORE) -> DataFrame:
    """The best ``rows`` terms of each phrase, offered and withheld ones apart.

    ``terms``: term_id, name, synonyms, obsolete, subsets.  Obsolete terms and
    groupings count for the statistics and are withheld, never dropped.  Of the
    terms that have a text, only the first ``rows`` by id can be among the best,
    since the others score no less by it.
    """
    about = terms.select("term_id", "name", F.coalesce("obsolete", F.lit(False)).alias("obsolete"), usage_of(F.col("subsets")).alias("usage"))
    about = about.withColumn("disposition", F.when(F.col("obsolete") | (F.col("usage") == "grouping"), "withheld").otherwise("offered"))
    texts = term_texts(terms)
    held = texts.select("term_id", F.lower(strip(F.col("text"))).alias("text")).distinct().join(about.select("term_id", "disposition"), "term_id")
    first = F.row_number().over(W.partitionBy("text", "disposition").orderBy("term_id"))
    held = held.withColumn("_n", first).where(F.col("_n") <= rows).drop("_n")
    found = scores(phrases, texts, idf(texts), least).join(held, "text")
    found = found.groupBy("phrase_id", "disposition", "term_id").agg(F.max("exact").alias("exact"), F.max("score").alias("score"))
    order = W.partitionBy("phrase_id", "disposition").orderBy(F.desc("exact"), F.desc(F.round("score", 9)), "term_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    return best.join(about.drop("disposition"), "term_id")


def match_status(phrases: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per phrase with a status: exact, candidates, withheld_only, no_match."""
    by = matches.groupBy("phrase_id").agg(
        F.count_if(F.col("disposition") == "offered").alias("n_offered"), F.count_if(F.col("disposition") == "withheld").alias("n_withheld"),
        F.bool_or(F.col("exact") & (F.col("disposition") == "offered")).alias("any_exact"),
    )
    out = phrases.join(by, "phrase_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_offered", "n_withheld")})
    status = F.when(F.coalesce("any_exact", F.lit(False)), "exact").when(F.col("n_offered") > 0, "candidates").when(F.col("n_withheld") > 0, "withheld_only").otherwise("no_match")
    return out.withColumn("status", status).drop("any_exact")


def term_context(label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")).rlike(r"(?i)\bhost\b"), "in-host").otherwise("unspecified")


def context_review(phrases: DataFrame, matches: DataFrame, context: str) -> DataFrame:
    """Per phrase: candidates usable and mismatched for an assay's context; only an
    in-host term for a free-living assay is a mismatch.  A phrase without
    candidates has none of either."""
    if context not in CONTEXTS:
        raise ValueError(f"unknown assay context {context!r}")
    wrong = (term_context(F.col("name")) == "in-host") & F.lit(context == "free-living")
    by = matches.groupBy("phrase_id").agg(F.count_if(~wrong).alias("n_usable"), F.count_if(wrong).alias("n_mismatched"))
    out = phrases.select("phrase_id").join(by, "phrase_id", "left").fillna(0, ["n_usable", "n_mismatched"])
    return out.withColumn("all_mismatched", (F.col("n_usable") == 0) & (F.col("n_mismatched") > 0))
