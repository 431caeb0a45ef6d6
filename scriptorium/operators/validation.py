"""Identifiers, records and values against reference tables.

Everything resolves by left joins with an explicit status; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scriptorium.functions.identifiers import canonical_prefix, format_valid, local_part
from scriptorium.functions.text import normal_pmid, strip


def validate_ids(ids: DataFrame, index: DataFrame, indexed: tuple[str, ...], skipped: tuple[str, ...] = (), broken: tuple[str, ...] = ()) -> DataFrame:
    """``ids`` (input_id) with prefix, format_valid, existence, label, ok.

    ``index``: term_id, label, obsolete and perhaps ``place``, of the prefixes
    ``indexed``; of terms that repeat an id the last place counts, of equal places
    the one that is not obsolete.  The first that holds: unknown_prefix,
    format_invalid, format_checked_only (no index has the prefix), not_checked
    (the prefix is among ``skipped``), error (its index is among the ``broken``
    ones, which could not be read), not_found, obsolete, exists.  Badly formed ids
    look nothing up, and each id is looked up once.
    """
    c = F.col("input_id")
    out = ids.withColumns({"prefix": canonical_prefix(c), "format_valid": format_valid(c)})
    out = out.withColumn("key", F.when(F.col("format_valid"), F.concat("prefix", F.lit(":"), local_part(c))))
    place = F.col("place") if "place" in index.columns else F.lit(0)
    term = F.max(F.struct(place.alias("at"), (~F.coalesce("obsolete", F.lit(False))).alias("live"), F.coalesce("label", F.lit("")).alias("label")))
    known = index.groupBy(F.col("term_id").alias("key")).agg(term.alias("t"))
    out = out.join(known.select("key", "t.label", (~F.col("t.live")).alias("obsolete")), "key", "left")
    existence = (
        F.when(F.col("prefix").isNull(), "unknown_prefix")
        .when(~F.col("format_valid"), "format_invalid")
        .when(~F.col("prefix").isin(*indexed), "format_checked_only")
        .when(F.col("prefix").isin(*skipped), "not_checked")
        .when(F.col("prefix").isin(*broken), "error")
        .when(F.col("label").isNull(), "not_found")
        .when(F.col("obsolete"), "obsolete")
        .otherwise("exists")
    )
    ok = F.col("existence").isin("exists", "format_checked_only")
    return out.withColumn("existence", existence).withColumn("ok", ok).drop("key", "obsolete")


def curated_lookup(queries: DataFrame, release: DataFrame) -> DataFrame:
    """``queries`` (pmid) with the number of records of a release (pmid, ...) and a status."""
    n = release.groupBy(normal_pmid(F.col("pmid")).alias("pmid")).agg(F.count(F.lit(1)).alias("n_records"))
    out = queries.withColumn("pmid", normal_pmid(F.col("pmid"))).join(n, "pmid", "left")
    return out.withColumn("n_records", F.coalesce("n_records", F.lit(0))).withColumn("status", F.when(F.col("n_records") > 0, "curated").otherwise("not_curated"))


def release_listing(release: DataFrame, keys: list[str], order: list[Column], first: int = 5) -> tuple[DataFrame, DataFrame]:
    """The first records of each key, and what the rest holds: rows of both."""
    ranked = release.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= first), ranked.where(F.col("rank") > first)


def release_stats(release: DataFrame, pmid: Column) -> DataFrame:
    numeric = strip(pmid).rlike("^[0-9]+$")
    return release.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(F.when(numeric, pmid)).alias("n_pmids"), F.count_if(~F.coalesce(numeric, F.lit(False))).alias("n_non_pubmed"))


def resolve_proteins(queries: DataFrame, proteins: DataFrame) -> DataFrame:
    """``queries`` (query_id, name, taxon, kind) with the number of candidates, the
    first of them (reviewed before others, then input order) and a status.

    A locus that finds nothing within its taxon is looked for in all taxa, and
    the answer says so.
    """
    p = proteins.select("accession", "name", "taxon", "reviewed", "position")

    def found(q: DataFrame, on: list[str]) -> DataFrame:
        first = F.min(F.struct((~F.col("reviewed")).alias("late"), F.col("position").alias("position"), F.col("accession").alias("accession"))).getField("accession")
        return q.join(p.drop(*[c for c in ("taxon",) if c not in on]), on).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), first.alias("accession"))

    strict = queries.join(found(queries, ["name", "taxon"]), "query_id", "left")
    hit, missed = strict.where("n is not null").withColumn("organism_filter_relaxed", F.lit(False)), strict.where("n is null").drop("n", "accession")
    loose = missed.join(found(missed.where("kind = 'locus'"), ["name"]), "query_id", "left").withColumn("organism_filter_relaxed", F.col("n").isNotNull())
    out = hit.unionByName(loose).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous"))


def identifier_kind(c: Column) -> Column:
    """pmid, pmcid, doi or error."""
    s = strip(c)
    return F.when(s.rlike("^[0-9]+$"), "pmid").when(s.rlike("(?i)^PMC[0-9]+$"), "pmcid").when(s.rlike(r"^10\.[0-9]{4,9}/\S+$") | F.lower(s).startswith("doi:"), "doi").otherwise("error")


def route_for(open_access: Column, pmcid: Column, has_pdf: Column) -> Column:
    return F.when(open_access & (F.coalesce(pmcid, F.lit("")) != ""), "jats").when(has_pdf, "pdf").otherwise("abstract")


# Source routes by suffix and by other spellings.
ROUTES = ("pdf", "jats-publisher", "jats-europepmc")
ROUTE_ALIASES = {"europepmc-jats-with-figures": "jats-europepmc", "europepmc": "jats-europepmc", "jats": "jats-publisher", "xml": "jats-publisher"}
ROUTE_SUFFIXES = {".pdf": "pdf", ".xml": "jats-publisher", ".jats": "jats-publisher", ".nxml": "jats-europepmc"}


def source_route(explicit: Column, file: Column) -> Column:
    """A named route before the one that a file's suffix suggests."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    named = F.try_element_at(pairs({r: r for r in ROUTES} | ROUTE_ALIASES), F.lower(strip(explicit)))
    return F.coalesce(named, F.try_element_at(pairs(ROUTE_SUFFIXES), F.lower(F.regexp_extract(file, r"\.[^./]+$", 0))))


def reported_route(route: Column, pmcid: Column, graphics: Column) -> Column:
    """The route after conversion: a paper with a PMC id whose graphics came with it is full text."""
    return F.when((F.coalesce(pmcid, F.lit("")) != "") & (F.coalesce(graphics, F.lit(0)) > 0), "jats-europepmc").otherwise(route)


def figures_available(route: Column, inspected: Column) -> Column:
    """Whether panels could be read: as recorded, else as the route usually has it."""
    return F.coalesce(inspected, source_route(route, F.lit("")).isin("pdf", "jats-europepmc"), F.lit(False))


def source_note(route: Column, file: Column, inspected: Column) -> Column:
    """(label, evidence, warn) of what a draft was read from; null where nothing is recorded.

    A route names its label; without one the file's name stands for it and the
    evidence is not recorded.  What was inspected overrides what the route says.
    """
    name = F.nullif(F.regexp_extract(F.coalesce(file, F.lit("")), r"[^/]*$", 0), F.lit(""))
    found = source_route(route, file)
    label = F.when(found == "pdf", "PDF").when(found == "jats-publisher", "publisher JATS XML").when(found == "jats-europepmc", "Europe PMC JATS XML")
    evidence = F.when(inspected, "inspected").when(~inspected, "captions only").when(found.isNull(), "not recorded").when(found == "jats-publisher", "captions only").otherwise("retrieved")
    return F.when(label.isNotNull() | name.isNotNull(), F.struct(F.coalesce(label, name).alias("label"), evidence.alias("evidence"), evidence.isin("captions only", "not recorded").alias("warn")))


def range_kind(c: Column) -> Column:
    """The kind of value a relation takes, by the head of its range."""
    head = strip(F.substring_index(c, "|", 1))
    exact = {"Text": "free_text", "GeneID": "gene_id", "ProteinID": "protein_id", "MetagenotypeID": "metagenotype_id", "PathogenTaxonID": "taxon_id", "HostTaxonID": "taxon_id"}
    kind = F.when(F.lit(False), "")
    for k, v in exact.items():
        kind = kind.when(head == k, v)
    for k in ("PHIPO_EXT", "FYPO_EXT", "PHIPO", "BTO"):
        kind = kind.when(head.startswith(k + ":"), k.lower() + "_term")
    return kind.otherwise("unknown")


def relation_rollup(rows: DataFrame) -> DataFrame:
    """One row per relation of (row_no, relation, range_id, display, types, domain, cardinality)."""
    each = {c: F.array_sort(F.collect_set(c)) for c in ("display", "types", "domain", "cardinality")}
    return rows.groupBy(strip(F.col("relation")).alias("relation")).agg(F.min_by("range_id", "row_no").alias("range_id"), *[v.alias(k) for k, v in each.items()])


def check_codes(values: DataFrame, codes: DataFrame) -> DataFrame:
    """``values`` (type, value) counted, with whether the type's own list has them.
    A type without a list checks nothing."""
    counted = values.where("value is not null and value <> ''").groupBy("type", "value").agg(F.count(F.lit(1)).alias("n"))
    listed = codes.groupBy("type").agg(F.count(F.lit(1)).alias("n_codes"))
    out = counted.join(listed, "type", "left").join(codes.withColumnRenamed("code", "value").withColumn("known", F.lit(True)).distinct(), ["type", "value"], "left")
    status = F.when(F.col("n_codes").isNull(), "unchecked").when(F.col("known"), "ok").otherwise("bad")
    return out.select("type", "value", "n", status.alias("status"))


#: Letters of the pieces by which codes are looked up.
GRAM = 3


def grams(c: Column, n: int | Column = GRAM) -> Column:
    """Distinct pieces of ``n`` letters, or the whole of a shorter text."""
    n = F.least(F.lit(n) if isinstance(n, int) else n, F.length(c))
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, n)))


def _holders(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """Pairs (type, needle, straw) of a type of which the straw holds the needle.

    Straws are indexed by their grams; a needle meets those that have its rarest
    one, and each pair is then compared in full.  ``needles``: type, needle;
    ``hay``: type, straw; both distinct and lower-cased, no needle empty.
    """
    # a needle shorter than a gram is looked up by all of itself
    short = F.array_distinct(F.concat(grams(F.col("straw")), grams(F.col("straw"), 1), grams(F.col("straw"), 2)))
    index = hay.withColumn("gram", F.explode(short))
    often = index.groupBy("type", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = needles.withColumn("gram", F.explode(grams(F.col("needle")))).join(often, ["type", "gram"], "left")
    # a gram that no straw has excludes the needle; as the rarest it meets nothing
    rare = asked.groupBy("type", "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rare.join(index, ["type", "gram"]).where(F.contains("straw", F.col("needle"))).select("type", "needle", "straw")


def near_codes(values: DataFrame, codes: DataFrame, least: int = 5, first: int = 3) -> DataFrame:
    """Up to three codes of a value's type of which either holds the other; what is
    held has ``least`` letters at least."""
    v = values.where("value is not null").select("type", F.lower("value").alias("v")).distinct()
    c = codes.where("code is not null").select("type", F.lower("code").alias("c")).distinct()
    long = lambda df, name: df.where(F.length(name) >= least).withColumnRenamed(name, "needle")
    in_code = _holders(long(v, "v"), c.withColumnRenamed("c", "straw")).select("type", F.col("needle").alias("v"), F.col("straw").alias("c"))
    in_value = _holders(long(c, "c"), v.withColumnRenamed("v", "straw")).select("type", F.col("straw").alias("v"), F.col("needle").alias("c"))
    spelled = codes.select("type", F.lower("code").alias("c"), "code").distinct()
    found = in_code.unionByName(in_value).distinct().join(spelled, ["type", "c"])
    top = found.withColumn("_n", F.row_number().over(W.partitionBy("type", "v").orderBy("code"))).where(F.col("_n") <= first)
    lists = top.groupBy("type", F.col("v").alias("_v")).agg(F.array_sort(F.collect_list("code")).alias("suggestions"))
    out = values.withColumn("_v", F.lower("value")).join(lists, ["type", "_v"], "left").drop("_v")
    return out.withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def one_vocabulary(values: DataFrame, codes: DataFrame, unverified: Column | None = None) -> DataFrame:
    """``values`` (type, value) with valid, did_you_mean (codes of the type that hold
    the value, whatever the case) and warning, where the list is not the site's own."""
    known = codes.select("type", F.col("code").alias("value"), F.lit(True).alias("valid")).distinct()
    out = values.join(known, ["type", "value"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    asked = values.where("value <> ''").select("type", F.lower("value").alias("needle")).distinct()
    spelled = codes.where("code is not null").select("type", F.lower("code").alias("straw"), "code").distinct()
    near = _holders(asked, spelled.select("type", "straw").distinct()).join(spelled, ["type", "straw"]).groupBy("type", F.col("needle").alias("_v")).agg(F.array_sort(F.collect_set("code")).alias("near"))
    # the empty text lies within every code
    every = spelled.groupBy("type").agg(F.array_sort(F.collect_set("code")).alias("near")).withColumn("_v", F.lit(""))
    blank = every.join(values.where("value = ''").select("type").distinct(), "type")
    out = out.withColumn("_v", F.lower("value")).join(near.unionByName(blank, allowMissingColumns=True), ["type", "_v"], "left").drop("_v")
    warning = F.when(F.lit(False) if unverified is None else unverified, "defaults only: unverified")
    return out.withColumns({"did_you_mean": F.when(~F.col("valid"), F.col("near")), "warning": warning}).drop("near")


# Kinds of ranges that are not checked for their form, and forms of the others.
UNCHECKED_KINDS = ("free_text", "gene_id", "protein_id", "metagenotype_id", "taxon_id", "unknown")
TERM_FORMS = {"phipo_term": r"^PHIPO:[0-9]{7}$", "bto_term": r"^BTO:[0-9]{7}$", "phipo_ext_term": r"^PHIPO_EXT:[0-9]{7}$", "fypo_ext_term": r"^FYPO_EXT:[0-9]{7}$"}
QUANTITY = r"^[0-9]+(\.[0-9]+)?\s*%?$"


def extension_check(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """``pairs`` (relation, value) with attested (the relation is in ``relations``:
    relation, range_id), kind, and status: ok, unknown relation, or wrong type.
    Where a range takes severities a quantity will do."""
    known = relations.groupBy(strip(F.col("relation")).alias("_key")).agg(F.min("range_id").alias("range_id"))
    out = pairs.withColumn("_key", strip(F.col("relation"))).join(known.withColumn("attested", F.lit(True)), "_key", "left").drop("_key")
    out = out.withColumn("attested", F.coalesce("attested", F.lit(False))).withColumn("kind", F.when(F.col("attested"), range_kind(F.col("range_id"))))
    value, fits = strip(F.coalesce("value", F.lit(""))), F.lit(False)
    for kind, form in TERM_FORMS.items():
        fits = fits | ((F.col("kind") == kind) & value.rlike(form))
    fits = fits | ((F.col("kind") == "fypo_ext_term") & value.rlike(QUANTITY)) | F.col("kind").isin(*UNCHECKED_KINDS)
    return out.withColumn("status", F.when(~F.col("attested"), "unknown relation").when(fits, "ok").otherwise("wrong type"))


#: Results of a check by which an annotation is parked; one that could not be made never parks.
PARKING = ("obsolete", "not_found", "format_invalid", "unknown_prefix")


def with_bad_terms(annotations: DataFrame, index: DataFrame, indexed: tuple[str, ...]) -> DataFrame:
    """``annotations`` (term_id, ...) with bad_term: what is wrong with the id, null
    if nothing or there is none.  Each distinct id is checked once."""
    ids = annotations.select(strip(F.col("term_id")).alias("input_id")).where("input_id <> ''").distinct()
    checked = validate_ids(ids, index, indexed).where(F.col("existence").isin(*PARKING)).select(F.col("input_id").alias("_id"), F.col("existence").alias("bad_term"))
    return annotations.withColumn("_id", strip(F.col("term_id"))).join(checked, "_id", "left").drop("_id")


def defining_terms(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """``asked`` (term_id) with the label of one of ``hits`` (term_id, label, defining,
    place): the first by place that defines the term, else the first; status says
    which, or not_found.  Ids agree whatever their case."""
    order = F.struct((~F.coalesce("defining", F.lit(False))).alias("late"), "place", "label")
    best = hits.groupBy(F.upper("term_id").alias("_key")).agg(F.min(order).alias("h"))
    out = asked.withColumn("_key", F.upper("term_id")).join(best, "_key", "left")
    status = F.when(F.col("h").isNull(), "not_found").when(F.col("h.late"), "first").otherwise("defining")
    return out.select(*asked.columns, F.col("h.label").alias("label"), status.alias("status"))


def identifier_query(c: Column) -> Column:
    """The search term for an identifier of any kind; null for none."""
    s, kind = strip(c), identifier_kind(c)
    return F.when(kind == "pmid", F.concat(F.lit("EXT_ID:"), s)).when(kind == "pmcid", F.concat(F.lit("PMCID:"), F.upper(s))).when(kind == "doi", F.concat(F.lit("DOI:"), F.regexp_replace(s, "(?i)^doi:", "")))


def record_ref(source: Column, id_: Column) -> Column:
    """The composite key of a publication record; MED where no source is named."""
    return F.concat(F.coalesce(F.nullif(source, F.lit("")), F.lit("MED")), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")))


def publication_records(asked: DataFrame, records: DataFrame, others: int = 4) -> DataFrame:
    """``asked`` (identifier) with the first record by place that has it, how many do,
    up to ``others`` further ones, and status: found, ambiguous, not_found, error
    (not an identifier).  ``records``: source, id, pmid, pmcid, doi, place."""
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key"))
    keys = F.array(key("pmid", F.col("pmid")), key("pmcid", F.upper("pmcid")), key("doi", F.col("doi")))
    held = records.select("place", record_ref(F.col("source"), F.col("id")).alias("ref"), F.explode(keys).alias("k")).where("k.key is not null and k.key <> ''").select("k.kind", "k.key", "place", "ref")
    held = held.withColumn("_n", F.row_number().over(W.partitionBy("kind", "key").orderBy("place", "ref")))
    # the first few are gathered; the rest are only counted
    by = held.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_hits"), F.min_by("ref", "_n").alias("ref"), F.array_sort(F.collect_list(F.when((F.col("_n") > 1) & (F.col("_n") <= others + 1), F.struct("_n", "ref")))).alias("o"))
    out = asked.withColumns({"kind": identifier_kind(F.col("identifier")), "key": F.substring_index(identifier_query(F.col("identifier")), ":", -1)})
    out = out.withColumn("query", identifier_query(F.col("identifier"))).join(by, ["kind", "key"], "left").drop("key")
    out = out.withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "other_hits": F.coalesce(F.transform("o", lambda x: x.ref), F.array().cast("array<string>"))}).drop("o")
    return out.withColumn("status", F.when(F.col("kind") == "error", "error").when(F.col("n_hits") == 0, "not_found").when(F.col("n_hits") > 1, "ambiguous").otherwise("found"))


def payload_kind(content: Column) -> Column:
    """archive, error (an error message in XML), empty or other, by the first bytes."""
    head = F.decode(F.substring(content, 1, 400), "ISO-8859-1")
    error = F.substring(head, 1, 200).rlike(r"^\s*<\?xml") & head.contains("<errorBean>")
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty").when(error, "error").when(head.startswith("PK"), "archive").otherwise("other")


def bad_codes(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Values (type, value) that their type's list does not have: how often, and near codes."""
    return near_codes(check_codes(values, codes).where("status = 'bad'").drop("status"), codes)
