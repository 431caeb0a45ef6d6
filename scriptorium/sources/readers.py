"""Sources and sinks, with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.functions.text import strip, without_tags
from scriptorium.sources.quoted import numbered_lines, read_quoted_csv

GAP_EVENT = "ontology string, phrase string, outcome string, pmid string, context string, matched_term string, matched_via string, filed string, recorded_at string, seq long"
USAGE = "struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>"
TURN = f"message struct<model:string,usage:{USAGE},content:string>"
CANTO = (
    "genes array<struct<name:string,uniprot:string,organism:string,locus:string,note:string>>,"
    "alleles array<struct<name:string,gene:string,type:string,expression:string>>,"
    "genotypes array<struct<name:string,organism:string,alleles:array<string>,role:string,strain:string,background:string,paper_label:string>>,"
    "metagenotypes array<struct<name:string,pathogen_genotype:string,host_genotype:string,role:string>>,"
    "annotations array<struct<feature_type:string,feature:string,annotation_type:string,term_id:string,term_name:string,evidence:string,conditions:string,figure:string,note:string,"
    "hold:boolean,hold_reason:string,needs_figure:boolean,extensions:array<struct<relation:string,value:string>>>>"
)
DRAFT = (
    "meta struct<date:string,pmid:string,paper:string,system:string,draft_by:string,model:string>, triage string, auto_check map<string,string>, "
    f"flags array<struct<category:string,detail:string>>, canto struct<{CANTO}>, "
    "figure_inspection struct<media_dir:string,figures:array<struct<label:string,file:string,inspected:boolean,read:string,note:string,supports:array<string>>>>"
)
#: Names that a release's columns had over time, the current one first.
RELEASE_ALIASES = {
    "record_id": ("Record ID",), "gene": ("Gene_name", "Gene"), "species": ("Pathogen_species",), "pmid": ("Literature_ID", "PMID"),
    "source": ("Literature_source",), "phenotype": ("Phenotype_of_mutant",), "host": ("Experimental_host_species",),
}


def _tag(lines: str, tag: str) -> Column:
    """Values of a tag's lines within a stanza."""
    hits = F.filter(lines, lambda x: x.startswith(tag + ":"))
    return F.transform(hits, lambda x: F.trim(F.substr(x, F.lit(len(tag) + 2))))


def read_obo(spark: SparkSession, path: str, prefix: str, annotatable_only: bool = False, label_marks_obsolete: bool = True) -> DataFrame:
    """Term stanzas of one prefix: term_id, name, synonyms, obsolete, subsets, is_a.
    Files are split at stanza heads, so large ones are read in parallel."""
    raw = spark.read.option("lineSep", "\n[").text(path)
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(x))
    s = raw.where(F.col("value").startswith("Term]") | F.col("value").startswith("[Term]")).select(lines.alias("l"))
    synonyms = F.filter(F.transform(_tag("l", "synonym"), lambda x: F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"', 1)), lambda x: x != "")
    name = F.coalesce(F.try_element_at(_tag("l", "name"), F.lit(-1)), F.lit(""))
    tagged = F.coalesce(F.lower(F.try_element_at(_tag("l", "is_obsolete"), F.lit(-1))) == "true", F.lit(False))
    obsolete = tagged | F.lower(name).startswith("obsolete ") if label_marks_obsolete else tagged
    parents = F.transform(_tag("l", "is_a"), lambda x: F.trim(F.substring_index(x, "!", 1)))
    out = s.select(F.try_element_at(_tag("l", "id"), F.lit(-1)).alias("term_id"), name.alias("name"), synonyms.alias("synonyms"), obsolete.alias("obsolete"), _tag("l", "subset").alias("subsets"), parents.alias("is_a"))
    out = out.where(F.col("term_id").startswith(prefix + ":"))
    return out.where(~F.col("obsolete") & ~F.array_contains("subsets", "Grouping_terms")) if annotatable_only else out


def obo_release(spark: SparkSession, path: str) -> DataFrame:
    """(file, release): the data version that the head of each file names; a file
    without one has no row.  Only the record before the first stanza is looked at."""
    raw = spark.read.option("lineSep", "\n[").text(path).where("_metadata.file_block_start = 0 and not startswith(value, 'Term]')")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"(?m)^data-version:\s*(.+?)\s*$", 1).alias("release")).where("release <> ''")


def read_phrases(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    out = spark.read.text(path).select(strip(F.col("value")).alias("phrase")).where("phrase <> ''")
    return out.where("not startswith(phrase, '#')") if comments else out


def read_extension_config(spark: SparkSession, path: str) -> DataFrame:
    """Rows of four columns or more of a tab-separated file, trimmed, without its head."""
    cells = F.transform(F.split("value", "\t"), lambda x: strip(x))
    rows = spark.read.text(path).select("value", cells.alias("c"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.where((F.size("c") >= 4) & (F.lower(F.col("c")[0]) != "domain id"))
    at = lambda i: F.try_element_at("c", F.lit(i + 1))
    return rows.select(at(0).alias("domain"), at(1).alias("subset_relation"), at(2).alias("relation"), at(3).alias("range_id"), at(4).alias("display"), at(5).alias("help"), at(6).alias("cardinality"), at(7).alias("role"), at(8).alias("types"), at(9).alias("feature_type"))


def read_vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """(path, vocab, ord, value): the names that configuration files list below their
    top-level keys, given as plain text or as mappings with a ``name``.

    A key whose list holds no name has one row with a null value, so that
    ``catalog.overridden`` replaces by it too; keys of other kinds are left out.
    YAML needs the yaml package, JSON nothing.
    """

    def names(entries: list) -> list[str]:
        found = [x.get("name") if isinstance(x, dict) else x for x in entries]
        return [x for x in found if isinstance(x, str) and x]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, said in zip(part["path"], part["value"]):
                for key, entries in (_parsed(said) or {}).items():
                    if isinstance(entries, list):
                        rows += [(file, str(key), k, x) for k, x in enumerate(names(entries) or [None])]
            yield pd.DataFrame(rows, columns=["path", "vocab", "ord", "value"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.mapInPandas(run, "path string, vocab string, ord int, value string")


def _parsed(said: str) -> dict | None:
    """A configuration file's mapping; None where it holds something else."""
    if said.lstrip().startswith("{"):
        found = json.loads(said)
    else:
        import yaml

        found = yaml.safe_load(said)
    return found if isinstance(found, dict) else None


def read_release(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """All columns as text under their current names, cells with line breaks whole,
    files in as many tasks as they have splits; a head repeated among the rows goes."""
    df = read_quoted_csv(spark, path, RELEASE_ALIASES, **options)
    return df.where("record_id is null or trim(record_id) <> 'Record ID'")


def read_gap_ledger(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(GAP_EVENT).json(path)


def append_gaps(events: DataFrame, path: str) -> None:
    """Append the events that no invariant rejects (operators.ledger.checked_events)."""
    events.where("rejected is null").drop("rejected").write.mode("append").json(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns that report their usage, with their place (turn: the line) within the
    session and what they say (blob): text parts and tool inputs, or plain content,
    lower-cased.  Lines that cannot be read are skipped."""
    raw = numbered_lines(spark, path).select("file", "line", F.from_json("value", TURN).alias("t")).select("file", "line", "t.*")
    parts = F.from_json("message.content", "array<struct<type:string,text:string,input:string>>")
    said = F.concat_ws("\n", F.flatten(F.transform(parts, lambda p: F.array_compact(F.array(p.text, p.input)))))
    blob = F.lower(F.coalesce(F.when(F.col("message.content").startswith("["), said), "message.content", F.lit("")))
    u = lambda c: F.coalesce(F.col(f"message.usage.{c}"), F.lit(0))
    return raw.where("message.usage is not null").select(
        F.coalesce("message.model", F.lit("?")).alias("model"), u("input_tokens").alias("inp"), u("output_tokens").alias("out"), u("cache_creation_input_tokens").alias("cache_write"),
        u("cache_read_input_tokens").alias("cache_read"), blob.alias("blob"), F.col("file").alias("session"), F.col("line").alias("turn"),
    )


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, draft, said): the first JSON block of each Markdown file, in the
    declared shape and as it was said; status is ok, skipped (no block) or error (not JSON).

    ``said`` is a VARIANT: fields that the shape does not know, and those of another
    type than it declares, stay there to be asked for (``said_field``)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)```json\s*(.*?)```", 1).alias("block"))
    said = raw.withColumn("said", F.try_parse_json("block"))
    out = said.withColumn("draft", F.when(F.col("said").isNotNull(), F.from_json("block", DRAFT)))
    status = F.when(F.col("block") == "", "skipped").when(F.col("said").isNull(), "error").otherwise("ok")
    return out.select("path", status.alias("status"), "draft", F.when(F.col("block") != "", F.col("said")).alias("said"))


def said_field(place: str, kind: str = "string") -> Column:
    """A field of ``said``, whatever the declared shape makes of it; null if it is not
    there or cannot be of that kind.  ``place``: a JSON path, as ``$.meta.pmid``."""
    return F.try_variant_get("said", place, kind)


def read_frontmatter(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields): scalars and block lists of a note's head, as arrays."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1).alias("head"))
    entries = F.filter(F.split("head", r"\n(?=[^\s-])"), lambda x: x.contains(":"))
    key = lambda e: F.trim(F.substring_index(e, ":", 1))
    body = lambda e: F.regexp_extract(e, r"(?s)^[^:]*:(.*)$", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    values = lambda e: F.filter(F.transform(F.split(body(e), r"\n\s*-\s*|\A\s*-\s+"), clean), lambda v: (v != "") & (F.lower(v) != "null"))
    return raw.select("path", F.map_from_entries(F.transform(entries, lambda e: F.struct(key(e), values(e)))).alias("fields"))


def read_pipe_table(spark: SparkSession, path: str, columns: int = 4) -> DataFrame:
    """Cells of Markdown table rows of ``columns`` cells or more; rules are left out."""
    row = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    cells = F.transform(F.split(row, r"\|"), lambda x: F.trim(x))
    return spark.read.text(path).where("trim(value) like '|%'").select(cells.alias("cells")).where((F.size("cells") >= columns) & ~F.forall("cells", lambda x: x.rlike("^:?-*:?$")))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def stack_scorecards(sheets: list[DataFrame]) -> DataFrame:
    """The union of sheets with any item columns; what a sheet lacks is ''."""
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.fillna("").replace("Not applicable", "N/A")


PUBLICATION = "id string, source string, pmid string, pmcid string, doi string, title string, journalInfo struct<journal:struct<title:string>>, pubYear string, isOpenAccess string, inEPMC string, inPMC string, hasPDF string, hasSuppl string, hasTextMinedTerms string, license string"


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(PUBLICATION).json(path)
    flags = {c: F.upper(F.coalesce(c, F.lit("N"))) == "Y" for c in ("isOpenAccess", "inEPMC", "inPMC", "hasPDF", "hasSuppl", "hasTextMinedTerms")}
    return df.withColumns(flags | {"title": without_tags(F.col("title")), "journal": F.col("journalInfo.journal.title")}).drop("journalInfo")


PROTEIN = (
    "primaryAccession string, uniProtkbId string, entryType string, proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>,submissionNames:array<struct<fullName:struct<value:string>>>>, "
    "genes array<struct<geneName:struct<value:string>,synonyms:array<struct<value:string>>,orderedLocusNames:array<struct<value:string>>,orfNames:array<struct<value:string>>>>, "
    "organism struct<scientificName:string,taxonId:long>, comments array<struct<commentType:string,texts:array<struct<value:string,evidences:array<struct<evidenceCode:string>>>>>>"
)
#: Evidence codes of experiments.
EXPERIMENTAL = ("ECO:0000269", "ECO:0007744")


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(PROTEIN).json(path)
    none = F.array().cast("array<string>")
    names = F.flatten(F.transform("genes", lambda g: F.concat(F.array(g.geneName.value), *[F.coalesce(F.transform(g[k], lambda x: x.value), none) for k in ("synonyms", "orderedLocusNames", "orfNames")])))
    function = F.filter("comments", lambda c: c.commentType == "FUNCTION")
    texts = F.flatten(F.transform(function, lambda c: c.texts))
    return df.select(
        F.col("primaryAccession").alias("accession"), F.col("uniProtkbId").alias("entry_name"),
        F.coalesce("proteinDescription.recommendedName.fullName.value", F.try_element_at("proteinDescription.submissionNames", F.lit(1)).fullName.value).alias("protein_name"),
        F.array_distinct(F.array_compact(F.coalesce(names, none))).alias("gene_names"), F.col("organism.scientificName").alias("organism"), F.col("organism.taxonId").alias("taxon"),
        F.coalesce(F.col("entryType").contains("reviewed") & ~F.col("entryType").contains("unreviewed"), F.lit(False)).alias("reviewed"),
        F.array_join(F.transform(texts, lambda t: t.value), " ").alias("function"),
        F.coalesce(F.exists(texts, lambda t: F.exists(F.coalesce(t.evidences, F.array().cast("array<struct<evidenceCode:string>>")), lambda e: e.evidenceCode.isin(*EXPERIMENTAL))), F.lit(False)).alias("has_exp"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Cells as they are, quotes within them doubled."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_nested(df: DataFrame, keys: list[str], path: str) -> None:
    """One JSON object per key with its rows as an array."""
    rest = [c for c in df.columns if c not in keys]
    df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows")).write.mode("overwrite").json(path)
