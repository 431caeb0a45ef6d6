"""Curation drafts: referential integrity, holds that cascade, what is parked.

The parts of a draft refer to each other by name within the draft: alleles to
genes, genotypes to alleles, metagenotypes to two genotypes, annotations to any.
Each level is a left join; a missing parent is an error, a held or missing one
excludes what depends on it, and nothing is dropped: every annotation ends as
enter or parked, with its reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scriptorium.functions.shares import dealt
from scriptorium.functions.text import text_or_empty, truthy

# Phrases by which a claim says that nothing was assayed; types that need no term.
INTERPRETIVE = ("interpret", "homology-infer", "not demonstrated", "not assayed", "no direct", "no in-vitro", "no in vitro", "indirect", "inferred from")
NO_TERM_NEEDED, QUALIFIER_TYPES = "physical_interaction", ("wt_rna_expression", "wt_protein_expression")
HELD, UNDEFINED = "held", "undefined"


def gene_state(genes: DataFrame) -> DataFrame:
    """(draft, name, problem): a gene without accession is held."""
    return genes.select("draft", "name", F.when(text_or_empty(F.col("accession")) == "", HELD).alias("problem"))


def child_state(links: DataFrame, parents: DataFrame, shares: int | None = None, by: Sequence[str] = ("draft", "name")) -> DataFrame:
    """``links`` (draft, name, parent; a row per reference) against the level above:
    (draft, name, problem, missing).  A name that is not defined beats a held one,
    and either passes on.  Links may repeat; ``shares`` deals rows as ``dealt`` does,
    in the end ``by`` these keys: without those that are constants, as Spark deals
    rows anew, in shares of its own size, if a constant is among the keys."""
    # ``there`` is held or undefined if the parent is, ok if it is fine, null if it does not exist
    p = parents.select("draft", F.col("name").alias("parent"), F.coalesce("problem", F.lit("ok")).alias("there"))
    met = dealt(dealt(links, shares, "draft", "parent").join(dealt(p, shares, "draft", "parent"), ["draft", "parent"], "left"), shares, *by)
    problem = F.when(F.bool_or(F.col("parent").isNotNull() & F.col("there").isNull()), UNDEFINED).when(F.bool_or(F.col("there").isin(HELD, UNDEFINED)), HELD)
    missing = F.array_sort(F.collect_set(F.when(F.col("parent").isNotNull() & F.col("there").isNull(), F.col("parent"))))
    return met.groupBy("draft", "name").agg(problem.alias("problem"), missing.alias("missing"))


def park_reason(subject: Column, subject_problem: Column, feature_type: Column, a: dict[str, Column]) -> Column:
    """Why an annotation is parked, '' if it is not; the order of reasons counts.

    ``subject_problem``: 'absent' if the subject is not set up, its level's
    problem, or null.  ``a``: hold, hold_reason, term_id, term_name, type, note,
    bad_term (the status of an id that failed validation, or null).
    """
    no_term = text_or_empty(a["term_id"]) == ""
    interpretive = (a["type"] == "molecular_function") & F.lower(text_or_empty(a["note"])).rlike("|".join(INTERPRETIVE))
    exempt = (a["type"] == NO_TERM_NEEDED) | (a["type"].isin(*QUALIFIER_TYPES) & (text_or_empty(a["term_name"]) != ""))
    return (
        F.when(subject_problem == "absent", F.concat(F.lit("subject absent: "), subject))
        .when((feature_type == "gene") & (subject_problem == HELD), "gene held")
        .when(subject_problem == HELD, "subject held")
        .when(subject_problem == UNDEFINED, "subject undefined")
        .when(truthy(a["hold"]), F.coalesce(F.nullif(text_or_empty(a["hold_reason"]), F.lit("")), F.lit("on hold")))
        .when(no_term & F.coalesce(exempt, F.lit(False)), "")
        .when(no_term, "no term")
        .when(a["bad_term"].isNotNull(), F.concat(F.lit("term "), a["bad_term"]))
        .when(F.coalesce(interpretive, F.lit(False)), "not assayed")
        .otherwise("")
    )


def queue_items(annotations: DataFrame, states: DataFrame, sections: tuple[str, ...] | None = None, shares: int | None = None, by: Sequence[str] = ("draft", "feature_type", "feature")) -> DataFrame:
    """``annotations`` (draft, feature_type, feature, type, ...) with disposition
    and reason.  ``states``: (draft, feature_type, name, problem) of all levels.
    A type that no section takes is parked as well.  ``by``: see ``child_state``."""
    s = states.select("draft", "feature_type", F.col("name").alias("feature"), F.coalesce("problem", F.lit("ok")).alias("state"))
    on = ["draft", "feature_type", "feature"]
    return with_reasons(dealt(annotations, shares, *by).join(dealt(s, shares, *by), on, "left"), sections)


def with_reasons(out: DataFrame, sections: tuple[str, ...] | None = None) -> DataFrame:
    """Annotations with ``state`` (their subject's: a problem, ok, or null if it is
    not there) to disposition and reason."""
    problem = F.when(F.col("feature_type").isin("gene", "genotype", "metagenotype") & F.col("state").isNull(), "absent").otherwise(F.nullif("state", F.lit("ok")))
    cols = {c: F.col(c) for c in ("hold", "hold_reason", "term_id", "term_name", "type", "note", "bad_term")}
    reason = park_reason(F.col("feature"), problem, F.col("feature_type"), cols)
    out = out.withColumn("reason", reason).drop("state")
    if sections is not None:
        lost = (F.col("reason") == "") & ~F.coalesce(F.col("type").isin(*sections), F.lit(False))
        out = out.withColumn("reason", F.when(lost, "no section").otherwise(F.col("reason")))
    return out.withColumn("disposition", F.when(F.col("reason") == "", "enter").otherwise("parked"))


def _state_of(name: Column, states: Column) -> Column:
    """The state of the parts of one name: undefined beats held, null if there is none."""
    mine = F.filter(states, lambda s: s["name"] == name)
    has = lambda state: F.exists(mine, lambda s: s["state"] == state)
    return F.when(F.size(mine) == 0, F.lit(None)).when(has(UNDEFINED), UNDEFINED).when(has(HELD), HELD).otherwise("ok")


def _child_states(parts: Column, parents: Column, refs) -> Column:
    """(name, state) of parts, by the states of what they refer to."""

    def state(part: Column) -> Column:
        found = F.transform(F.filter(refs(part), lambda r: r.isNotNull()), lambda r: F.coalesce(_state_of(r, parents), F.lit("absent")))
        has = lambda *states: F.exists(found, lambda s: s.isin(*states))
        return F.when(has("absent"), UNDEFINED).when(has(HELD, UNDEFINED), HELD).otherwise("ok")

    return F.transform(parts, lambda p: F.struct(p["name"].alias("name"), state(p).alias("state")))


def folded_annotations(incoming: DataFrame) -> DataFrame:
    """Annotations of drafts (draft, canto), each with its subject's ``state``: the
    cascade from genes to metagenotypes as nested arrays, one level after the other,
    without a join.  All other columns of ``incoming`` are left out."""
    none = F.array().cast("array<struct<name:string,state:string>>")
    genes = F.transform(F.col("canto.genes"), lambda g: F.struct(g["name"].alias("name"), F.when(text_or_empty(g["uniprot"]) == "", HELD).otherwise("ok").alias("state")))
    level = lambda kind, parents, refs: F.coalesce(_child_states(F.col(f"canto.{kind}s"), F.col(parents), refs), none)
    rows = incoming.select("draft", "canto", F.coalesce(genes, none).alias("_gene"))
    rows = rows.withColumn("_allele", level("allele", "_gene", lambda a: F.array(a["gene"])))
    rows = rows.withColumn("_genotype", level("genotype", "_allele", lambda g: F.coalesce(g["alleles"], F.array().cast("array<string>"))))
    rows = rows.withColumn("_metagenotype", level("metagenotype", "_genotype", lambda m: F.array(m["pathogen_genotype"], m["host_genotype"])))
    a = rows.select("draft", F.posexplode("canto.annotations").alias("ord", "a"), "_gene", "_genotype", "_metagenotype")
    state = F.lit(None)
    for kind in ("gene", "genotype", "metagenotype"):
        state = F.when(F.col("a.feature_type") == kind, _state_of(F.col("a.feature"), F.col(f"_{kind}"))).otherwise(state)
    out = [F.col(f"a.{c}").alias(c) for c in ("feature_type", "feature", "hold_reason", "term_id", "term_name", "note", "evidence")]
    return a.select("draft", "ord", *out, F.col("a.hold").cast("string").alias("hold"), F.col("a.annotation_type").alias("type"), state.alias("state"))


def queue_counts(items: DataFrame, genes: DataFrame | None = None, shares: int | None = None) -> DataFrame:
    """Per draft: annotations to enter and parked; with ``genes`` (draft, name,
    problem) also genes to enter and held."""
    out = dealt(items, shares, "draft").groupBy("draft").agg(F.count_if(F.col("disposition") == "enter").alias("n_enter"), F.count_if(F.col("disposition") == "parked").alias("n_parked"))
    if genes is None:
        return out
    by = dealt(genes, shares, "draft").groupBy("draft").agg(F.count_if(F.col("problem").isNull()).alias("n_genes_enter"), F.count_if(F.col("problem").isNotNull()).alias("n_genes_held"))
    return out.join(by, "draft", "full").fillna(0, ["n_enter", "n_parked", "n_genes_enter", "n_genes_held"])


def unused_genotypes(genotypes: DataFrame, references: DataFrame) -> DataFrame:
    """Genotypes (draft, name) that nothing refers to."""
    return genotypes.select("draft", "name").join(references.select("draft", "name").distinct(), ["draft", "name"], "left_anti")


def is_mutant(alleles: Column, background: Column) -> Column:
    """By its alleles, or by a background: an insertion may carry no allele."""
    return (F.size(F.filter(F.coalesce(alleles, F.array().cast("array<string>")), lambda a: text_or_empty(a) != "")) > 0) | (text_or_empty(background) != "")


def strain_problem(name: Column, strain: Column, background: Column, alleles: Column) -> Column:
    """What is wrong with a genotype's strain and background, null if nothing: a
    wild type has a strain, a mutant a background, none both.  Unnamed ones pass."""
    mutant, has_strain, has_background = is_mutant(alleles, background), text_or_empty(strain) != "", text_or_empty(background) != ""
    problem = F.when(has_strain & has_background, "both strain and background").when(mutant & has_strain, "mutant with a strain").when(mutant & ~has_background, "mutant without background").when(~mutant & ~has_strain, "wild type without strain")
    return F.when(text_or_empty(name) != "", problem)


def organism_rollup(genes: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(draft, organism, role, strains, wild_types) of every organism of a draft.

    ``genes``: draft, organism; ``genotypes``: draft, seq, name, organism, strain,
    background, alleles, role (as metagenotypes use it, null if they do not).  A
    use outranks the pathogen that a declared gene suggests; the last one counts,
    of equal places the greater name.
    Only wild types give strains; those without one are named instead.
    """
    cols = {c: text_or_empty(F.col(c)) for c in ("organism", "name", "strain")}
    wild = ~is_mutant(F.col("alleles"), F.col("background"))
    g = genotypes.select("draft", "seq", *[v.alias(k) for k, v in cols.items()], wild.alias("wild"), "role")
    g = g.unionByName(genes.select("draft", F.lit(None).cast("long").alias("seq"), text_or_empty(F.col("organism")).alias("organism"), F.lit("").alias("name"), F.lit("").alias("strain"), F.lit(False).alias("wild"), F.lit(None).cast("string").alias("role")))
    used = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"]
    role = F.coalesce(used, F.when(F.bool_or(F.col("seq").isNull()), "pathogen"))
    strains = F.array_sort(F.collect_set(F.when(F.col("wild") & (F.col("strain") != ""), F.col("strain"))))
    unnamed = F.array_sort(F.collect_list(F.when(F.col("wild") & (F.col("strain") == "") & (F.col("name") != ""), F.col("name"))))
    return g.where("organism <> ''").groupBy("draft", "organism").agg(role.alias("role"), strains.alias("strains"), unnamed.alias("wild_types"))


def section_numbers(rows: DataFrame, order: str) -> DataFrame:
    """(draft, type, n): sections that have rows, numbered without gaps in their fixed order."""
    present = rows.groupBy("draft", "type").agg(F.min(order).alias("_at"))
    return present.select("draft", "type", F.row_number().over(W.partitionBy("draft").orderBy("_at", "type")).alias("n"))


def genotype_roles(genotypes: DataFrame, metagenotypes: DataFrame) -> DataFrame:
    """``genotypes`` (draft, name, ...) with role: host or pathogen as metagenotypes
    (draft, pathogen_genotype, host_genotype) use it, host first; null if none does."""
    sides = F.array(F.struct(F.col("host_genotype").alias("name"), F.lit("host").alias("role")), F.struct(F.col("pathogen_genotype").alias("name"), F.lit("pathogen").alias("role")))
    used = metagenotypes.select("draft", F.explode(sides).alias("s")).select("draft", "s.name", "s.role").groupBy("draft", "name").agg(F.min("role").alias("role"))
    return genotypes.drop("role").join(used, ["draft", "name"], "left")


def annotation_references(annotations: DataFrame) -> DataFrame:
    """(draft, name): what annotations (draft, feature, extensions) point at, features
    and the values of controls, several of which may stand between semicolons."""
    controls = F.filter(F.coalesce("extensions", F.array().cast("array<struct<relation:string,value:string>>")), lambda e: text_or_empty(e.relation) == "compared_to_control")
    named = F.flatten(F.transform(controls, lambda e: F.split(text_or_empty(e.value), ";")))
    every = F.transform(F.concat(F.array("feature"), named), text_or_empty)
    return annotations.select("draft", F.explode(every).alias("name")).where("name <> ''").distinct()


def genotype_usage(genotypes: DataFrame, metagenotypes: DataFrame, annotations: DataFrame) -> DataFrame:
    """``genotypes`` (draft, name, role: as declared) with usage: ok; unused (neither
    a metagenotype, an annotation nor a control names it); no metagenotype (a
    pathogen that only annotations name).  A host is one by use or declaration."""
    side = lambda c, flag: metagenotypes.select("draft", text_or_empty(F.col(c)).alias("name")).distinct().withColumn(flag, F.lit(True))
    out = genotypes.where(text_or_empty(F.col("name")) != "").join(side("host_genotype", "_host"), ["draft", "name"], "left").join(side("pathogen_genotype", "_path"), ["draft", "name"], "left")
    out = out.join(annotation_references(annotations).withColumn("_named", F.lit(True)), ["draft", "name"], "left")
    host, path, named = (F.coalesce(c, F.lit(False)) for c in ("_host", "_path", "_named"))
    is_host = host | F.lower(text_or_empty(F.col("role"))).contains("host")
    usage = F.when(~host & ~path & ~named, "unused").when(is_host & ~host & ~named, "unused").when(~is_host & ~path, "no metagenotype").otherwise("ok")
    return out.withColumn("usage", usage).drop("_host", "_path", "_named")
