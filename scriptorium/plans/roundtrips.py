"""The driver's tables written as the files that readers take, read again by them,
each with the same in DuckDB SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.operators import ledger, scoring
from scriptorium.plans.queries import EVENTS, event_ledger, query, ratings, table
from scriptorium.sources import articles, readers
from scriptorium.streaming.jobs import work_folder


def as_text(rows: DataFrame, line: Column, files_by: str | None = None) -> str:
    """A folder of text files with ``line`` of every row; with ``files_by``, one file
    for each of its values."""
    folder = work_folder(rows.sparkSession)
    out = rows.select(line.alias("line"), *([files_by] if files_by else []))
    writer = out.repartition(files_by).write.partitionBy(files_by) if files_by else out.write
    writer.text(folder)
    return folder


def lines_of(c: str) -> Column:
    """The lines of a text that say something, white space collapsed, without what XML cannot hold."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x08\\x0E-\\x1B\\uFFFE\\uFFFF]", ""), "[\\t\\x0B\\x0C\\r\\x1C-\\x1F\\x85\\p{Z}]+", " ")
    return F.filter(F.transform(F.split(one, "\n"), lambda x: F.trim(x)), lambda x: x != "")


LINES = r"""li AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0e-\x1b\x{fffe}\x{ffff}]', '', 'g'), '[\t\x0b\x0c\r\x1c-\x1f\x{85}\pZ]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)"""


def article_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as archives of article XML, every tenth of them broken; read again
    as (doc, xml, status)."""
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = F.col("doc_id").cast("string")
    paragraphs = F.array_join(F.transform(lines_of("text"), lambda x: F.concat(F.lit("<p>"), xml(x), F.lit("</p>"))), "")
    cited = F.array_join(F.transform(F.slice(lines_of("text"), 1, 3), lambda x, i: F.concat(F.lit('<ref id="r'), i.cast("string"), F.lit('"><label>'), (i + 1).cast("string"), F.lit("</label><mixed-citation>"), xml(x), F.lit('<pub-id pub-id-type="pmid">'), n, F.lit("</pub-id></mixed-citation></ref>"))), "")
    said = F.concat(
        F.lit('<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title>'), xml(F.coalesce("source", F.lit(""))), F.lit('</journal-title></journal-meta><article-meta><article-id pub-id-type="pmid">'), n,
        F.lit("</article-id><title-group><article-title>In <italic>"), F.coalesce("lang", F.lit("")), F.lit("</italic></article-title></title-group></article-meta></front><body><sec><title>All</title>"), paragraphs,
        F.lit('<sec><title>Deep</title><p>end</p></sec></sec><fig id="f1"><label>Figure 1</label><caption><p>Shown</p></caption><graphic xlink:href="'), n, F.lit('.jpg"/></fig><fig id="f1"><label>again</label></fig>'),
        F.when(F.col("doc_id") % 10 == 9, "").otherwise("</body>"), F.lit("<back><ref-list>"), cited, F.lit("</ref-list></back></article>"),
    )
    folder = as_text(table(spark, d, "documents"), said)
    doc = F.regexp_extract("xml", 'pub-id-type="pmid">([0-9]+)<', 1).cast("long")
    return articles.read_articles(spark, folder).select(doc.alias("doc"), "xml", "status")


@query(f"""WITH {LINES} SELECT doc_id AS doc, CASE WHEN doc_id % 10 = 9 THEN 'broken' ELSE 'ok' END AS status, CASE WHEN doc_id % 10 <> 9 THEN CAST(doc_id AS VARCHAR) END AS pmid,
CASE WHEN doc_id % 10 <> 9 THEN 'In *' || lang || '*' END AS title, CASE WHEN doc_id % 10 <> 9 THEN source END AS journal FROM li""")
def article_xml(spark, d):
    """The metadata of archived articles, broken ones with their status."""
    return articles.article_table(article_files(spark, d), "metadata").select("doc", "status", "pmid", "title", "journal")


@query(f"""WITH {LINES} SELECT doc_id AS doc, 1 AS ord, 1 AS depth, 'All' AS title, len(l) AS n_blocks, md5(array_to_string(l, chr(10))) AS blocks FROM li WHERE doc_id % 10 <> 9
UNION ALL SELECT doc_id, 2, 2, 'Deep', 1, md5('end') FROM li WHERE doc_id % 10 <> 9 UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM li WHERE doc_id % 10 = 9""")
def article_sections(spark, d):
    out = articles.article_table(article_files(spark, d), "sections")
    return out.select("doc", "ord", "depth", "title", F.size(F.when(F.col("status") == "ok", F.col("blocks"))).cast("long").alias("n_blocks"), F.md5(F.array_join("blocks", "\n")).alias("blocks")).withColumn("n_blocks", F.when(F.col("ord").isNotNull(), F.col("n_blocks")))


@query("""SELECT doc_id AS doc, CASE WHEN doc_id % 10 = 9 THEN 'broken' ELSE 'ok' END AS status, CASE WHEN doc_id % 10 <> 9 THEN 'f1' END AS object_id, CASE WHEN doc_id % 10 <> 9 THEN 'Figure 1: Shown (' || doc_id || '.jpg)' END AS said FROM documents""")
def article_objects(spark, d):
    """Figures and tables; of two with one id the first counts."""
    out = articles.article_table(article_files(spark, d), "display_objects")
    said = F.concat("label", F.lit(": "), "caption", F.lit(" ("), F.array_join("graphics", ","), F.lit(")"))
    return out.select("doc", "status", "object_id", said.alias("said"))


@query(f"""WITH {LINES} SELECT doc_id AS doc, unnest(['ok']) AS status, 'r' || i AS ref_id, md5(l[i + 1] || doc_id) AS citation, CAST(doc_id AS VARCHAR) AS pmid FROM li, range(3) r(i) WHERE doc_id % 10 <> 9 AND i < len(l)
UNION ALL SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'broken' ELSE 'none' END, NULL, NULL, NULL FROM li WHERE doc_id % 10 = 9 OR len(l) = 0""")
def article_references(spark, d):
    out = articles.article_table(article_files(spark, d), "references")
    return out.select("doc", "status", "ref_id", F.md5("citation").alias("citation"), "pmid")


@query("""SELECT CAST(doc_id AS VARCHAR) AS record_id, lang AS gene, CAST(doc_id % 50 AS VARCHAR) AS pmid, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS phenotype, CAST(NULL AS VARCHAR) AS host FROM documents""")
def release_csv(spark, d):
    """Documents, line breaks and quotes and all, as cells of a release."""
    docs = table(spark, d, "documents")
    named = docs.select(F.col("doc_id").alias("Record ID"), F.col("lang").alias("Gene"), (F.col("doc_id") % 50).alias("PMID"), F.lit("PubMed").alias("Literature_source"), F.col("text").alias("Phenotype_of_mutant"))
    folder = work_folder(spark)
    named.write.csv(folder, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    said = F.coalesce("phenotype", F.lit(""))
    return readers.read_release(spark, folder).select("record_id", "gene", "pmid", F.length(said).cast("long").alias("n_chars"), F.md5(said).alias("phenotype"), "host")


@query("""SELECT 'X:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS term_id, p_name AS name, p_type || ' "' || p_brand || '"' AS synonym, p_size > 45 AS obsolete, p_type = 'PROMO' AS grouping, 'X:0000001' AS parent FROM part WHERE p_partkey % 5 <> 0""")
def ontology_terms(spark, d):
    """Parts as term stanzas, every fifth of another prefix, relations between."""
    terms = readers.read_obo(spark, term_files(spark, d), "X")
    return terms.select("term_id", "name", F.replace(F.col("synonyms")[0], F.lit('\\"'), F.lit('"')).alias("synonym"), "obsolete", F.array_contains("subsets", "Grouping_terms").alias("grouping"), F.col("is_a")[0].alias("parent"))


@query("""SELECT 'X:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS term_id, p_name AS name FROM part WHERE p_partkey % 5 <> 0 AND p_size <= 45 AND p_type <> 'PROMO'""")
def ontology_annotatable(spark, d):
    return readers.read_obo(spark, term_files(spark, d), "X", annotatable_only=True).select("term_id", "name")


@query("SELECT 'releases/' || n_name AS release, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING n_nationkey % 3 <> 0")
def ontology_releases(spark, d):
    """A term file for each nation, its suppliers the terms; every third names no release."""
    terms = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.collect_list("s_suppkey"), lambda k: F.concat(F.lit("[Term]\nid: X:"), F.lpad(k.cast("string"), 7, "0"), F.lit("\n\n"))), "").alias("said"))
    n = table(spark, d, "nation").join(terms, "n_nationkey", "left")
    head = F.concat(F.lit("format-version: 1.2\n"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("data-version: releases/"), "n_name", F.lit("\n"))), F.lit("\n"))
    folder = as_text(n, F.concat(head, F.coalesce("said", F.lit(""))), "n_nationkey")
    nation = lambda c: F.regexp_extract(c, "n_nationkey=([0-9]+)", 1)
    found = spark.read.option("lineSep", "\n[").text(folder).where("value like 'Term]%'").groupBy(nation(F.col("_metadata.file_path")).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    return readers.obo_release(spark, folder).withColumn("of", nation(F.col("file"))).join(found, "of", "left").select("release", F.coalesce("n", F.lit(0)).alias("n"))


def term_files(spark: SparkSession, d: str) -> str:
    n = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    stanza = F.concat(
        F.lit("[Term]\nid: "), F.when(F.col("p_partkey") % 5 == 0, "Y:").otherwise("X:"), n, F.lit("\nname: "), "p_name", F.lit('\nsynonym: "'), "p_type", F.lit(' \\"'), "p_brand", F.lit('\\"" EXACT []\nis_a: X:0000001 ! all\n'),
        F.when(F.col("p_size") > 45, "is_obsolete: true\n").otherwise(""), F.when(F.col("p_type") == "PROMO", "subset: Grouping_terms\n").otherwise(""), F.lit("\n[Typedef]\nid: X:part_of\n"),
    )
    return as_text(table(spark, d, "part"), stanza)


@query("""SELECT p_brand || ' x' AS relation, 'PHIPO:' || p_partkey AS range_id, p_name AS display, CASE WHEN p_size % 2 = 0 THEN 'r' END AS role FROM part WHERE p_size % 6 <> 0""")
def extension_file(spark, d):
    """Parts as rows of an extension file, some too short to count."""
    cells = F.concat_ws("\t", F.lit("GO:1"), F.lit("is_a"), F.concat("p_brand", F.lit(" x ")), F.concat(F.lit("PHIPO:"), F.col("p_partkey").cast("string")), "p_name", F.lit("help"), F.lit("1"))
    line = F.when(F.col("p_size") % 6 == 0, "short\trow").when(F.col("p_size") % 2 == 0, F.concat(cells, F.lit("\tr"))).otherwise(cells)
    return readers.read_extension_config(spark, as_text(table(spark, d, "part"), line)).select("relation", "range_id", "display", "role")


@query("""SELECT conv_id, turn, length(text) AS n_chars, 'm' || conv_id % 3 AS model, turn + 1 AS inp, 0 AS cache_read FROM conversations WHERE conv_id % 8 <> 0""")
def session_files(spark, d):
    """Conversations as lines of session files, some of them not JSON."""
    c = table(spark, d, "conversations").orderBy("conv_id", "turn")
    usage = F.struct((F.col("turn") + 1).alias("input_tokens"))
    part = F.array(F.struct(F.lit("text").alias("type"), F.concat_ws(" ", F.lit("turn"), "conv_id", "turn", F.concat(F.lit("|"), "text")).alias("text")))
    said = F.to_json(F.struct(F.struct(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), usage.alias("usage"), part.alias("content")).alias("message")))
    turns = readers.read_turns(spark, as_text(c, F.when(F.col("conv_id") % 8 == 0, F.concat(F.lit("{"), said)).otherwise(said)))
    place = F.split(F.substring_index("blob", "|", 1), " ")
    text = F.substr("blob", F.instr(F.col("blob"), "|") + 1)
    return turns.select(place[1].cast("long").alias("conv_id"), place[2].cast("long").alias("turn"), F.length(text).cast("long").alias("n_chars"), "model", "inp", "cache_read")


@query("SELECT p_name AS phrase, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY p_name")
def phrase_file(spark, d):
    line = F.when(F.col("p_size") % 8 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_size") % 4 == 0, " \t").otherwise(F.concat(F.lit("  "), "p_name", F.lit("\t ")))
    return readers.read_phrases(spark, as_text(table(spark, d, "part"), line)).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name AS title, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS tags, 0 AS n_empty FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def note_heads(spark, d):
    """Nations as notes whose heads list their suppliers."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x.s_name).alias("tags"))
    notes = table(spark, d, "nation").join(s, "n_nationkey", "left")
    listed = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n  - "), x)), "")
    line = F.concat(F.lit("---\ntitle: '"), "n_name", F.lit("'\nempty: null\ntags:"), listed, F.lit("\n---\nbody: none\n"))
    f = readers.read_frontmatter(spark, as_text(notes, line, "n_nationkey")).select("fields")
    return f.select(F.col("fields")["title"][0].alias("title"), F.array_join(F.col("fields")["tags"], ",").alias("tags"), F.size(F.col("fields")["empty"]).cast("long").alias("n_empty"))


@query("""WITH r AS (SELECT l_orderkey AS paper, l_linenumber, max(CASE l_returnflag WHEN 'A' THEN 'Correct' WHEN 'N' THEN 'Needs improvement' ELSE 'Incorrect' END) AS rating FROM lineitem GROUP BY 1, 2)
SELECT CAST(paper AS VARCHAR) AS paper, CASE WHEN paper % 3 = 0 THEN 'control' ELSE 'curated' END AS "group", round(avg(CASE rating WHEN 'Correct' THEN 1.0 WHEN 'Needs improvement' THEN 0.5 ELSE 0.0 END), 6) AS accuracy,
round(CASE WHEN paper % 5 <> 0 THEN paper % 8 / 7.0 END, 6) AS completeness FROM r GROUP BY paper""")
def score_sheets(spark, d):
    """Ratings as a wide sheet with a column for each item, read and made long again;
    of two ratings of one item the last in the alphabet is written."""
    ids = ["paper", "group", "curatable", "captured"]
    wide = ratings(spark, d).groupBy(*ids).pivot("item", [str(k) for k in range(1, 8)]).agg(F.max("rating"))
    folder = work_folder(spark)
    readers.write_csv(wide, folder)
    sheet = scoring.long_scores(readers.read_scores(spark, folder), ids).withColumns({c: F.col(c).cast("int") for c in ("curatable", "captured")})
    return scoring.paper_scores(sheet).select("paper", "group", F.round("accuracy", 6).alias("accuracy"), F.round("completeness", 6).alias("completeness"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation, 'x' AS note FROM supplier")
def pipe_tables(spark, d):
    s = table(spark, d, "supplier")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"), F.lit("x")), F.lit(" |\n|---|:---|---:|---|\nother text | with a bar\n| too | short |"))
    cells = readers.read_pipe_table(spark, as_text(s, row))
    return cells.select(*[F.col("cells")[k].alias(c) for k, c in enumerate(("id", "name", "nation", "note"))])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS pmid, 'On 1998 of ' || o_orderpriority AS title, o_orderstatus = 'F' AS open_access, false AS has_pdf, o_clerk AS journal FROM orders""".replace("o_clerk", "'J' || o_custkey"))
def publication_records(spark, d):
    """Orders as publication records with marked titles and Y/N flags."""
    o = table(spark, d, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("y")).otherwise("N")
    said = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("pmid"), F.concat(F.lit("On <i>1998</i> of "), "o_orderpriority").alias("title"), flag.alias("isOpenAccess"), F.struct(F.struct(F.concat(F.lit("J"), F.col("o_custkey").cast("string")).alias("title")).alias("journal")).alias("journalInfo")))
    return readers.read_publications(spark, as_text(o, said)).select("pmid", "title", F.col("isOpenAccess").alias("open_access"), F.col("hasPDF").alias("has_pdf"), "journal")


@query("""SELECT 'P' || p_partkey AS accession, p_name AS protein_name, p_brand || ',' || p_type || ',' || 'L' || p_size AS gene_names, p_size AS taxon, p_size % 2 = 0 AS reviewed, 'does ' || p_name AS function, p_partkey % 3 = 0 AS has_exp FROM part""")
def protein_entries(spark, d):
    """Parts as nested protein entries."""
    v = lambda c: F.struct(c.alias("value"))
    full = lambda c: F.struct(v(c).alias("fullName"))
    name, even = F.col("p_name"), F.col("p_size") % 2 == 0
    description = F.struct(F.when(even, full(name)).alias("recommendedName"), F.when(~even, F.array(full(name), full(F.lit("later")))).alias("submissionNames"))
    gene = F.struct(v(F.col("p_brand")).alias("geneName"), F.array(v(F.col("p_type")), v(F.col("p_brand"))).alias("synonyms"), F.array(v(F.concat(F.lit("L"), F.col("p_size").cast("string")))).alias("orderedLocusNames"))
    code = F.when(F.col("p_partkey") % 3 == 0, "ECO:0000269").otherwise("ECO:0000250")
    text = F.struct(F.concat(F.lit("does "), name).alias("value"), F.array(F.struct(code.alias("evidenceCode"))).alias("evidences"))
    comments = F.array(F.struct(F.lit("FUNCTION").alias("commentType"), F.array(text).alias("texts")), F.struct(F.lit("OTHER").alias("commentType"), F.array(text).alias("texts")))
    kind = F.when(even, "UniProtKB reviewed (Swiss-Prot)").otherwise("UniProtKB unreviewed (TrEMBL)")
    said = F.to_json(F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("primaryAccession"), kind.alias("entryType"), description.alias("proteinDescription"), F.array(gene).alias("genes"), F.struct(F.lit("x").alias("scientificName"), F.col("p_size").alias("taxonId")).alias("organism"), comments.alias("comments")))
    out = readers.read_proteins(spark, as_text(table(spark, d, "part"), said))
    return out.select("accession", "protein_name", F.array_join("gene_names", ",").alias("gene_names"), "taxon", "reviewed", "function", "has_exp")


@query(f"""WITH {EVENTS} SELECT CASE WHEN ontology IN ('click', 'view') THEN ontology END AS ontology, CASE WHEN value > 30 THEN 'synonym' ELSE 'gap' END AS outcome, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM e WHERE ontology IN ('click', 'view') GROUP BY 1, 2""")
def ledger_appends(spark, d):
    """The ledger appended in three batches and read again; what an invariant rejects stays out."""
    checked = ledger.checked_events(event_ledger(spark, d), ("CLICK", "VIEW"))
    folder = work_folder(spark)
    for k in range(3):
        readers.append_gaps(checked.where(F.col("seq") % 3 == k), folder)
    return readers.read_gap_ledger(spark, folder).groupBy("ontology", "outcome").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT l_orderkey AS draft, count(*) AS n_rows, sum(l_partkey)::BIGINT AS parts, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey")
def nested_sink(spark, d):
    """Lines nested by order, written as JSON and read again."""
    folder = work_folder(spark)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    readers.write_nested(rows, ["l_orderkey"], folder)
    back = spark.read.schema("l_orderkey long, rows array<struct<l_linenumber:int,l_partkey:long>>").json(folder)
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x.l_partkey)
    return back.select(F.col("l_orderkey").alias("draft"), F.size("rows").cast("long").alias("n_rows"), total.alias("parts"), F.col("rows")[0].l_linenumber.alias("first_line"))


@query("SELECT c_custkey AS id, c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'x' AS said, c_acctbal AS balance FROM customer")
def csv_sink(spark, d):
    """Cells with commas, quotes and line breaks through the CSV sink and the quoted reader."""
    folder = work_folder(spark)
    c = table(spark, d, "customer")
    readers.write_csv(c.select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx')).alias("said"), "c_acctbal"), folder)
    back = readers.read_quoted_csv(spark, folder, {"id": ("c_custkey",), "said": ("said",), "balance": ("c_acctbal",)})
    return back.select(F.col("id").cast("long").alias("id"), "said", F.col("balance").cast("double").alias("balance"))


@query("""SELECT r_name AS vocab, n_name AS value, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS ord FROM region JOIN nation ON n_regionkey = r_regionkey""")
def vocabulary_files(spark, d):
    """Nations as lists of configuration files, one for each region, plain or with a name."""
    one = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.col("n_name").alias("name")))).otherwise(F.concat(F.lit('"'), "n_name", F.lit('"')))
    by = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("v")))), lambda x: x.v), ", ").alias("names"))
    rows = table(spark, d, "region").join(by, "r_regionkey")
    line = F.concat(F.lit('{"'), "r_name", F.lit('": ['), "names", F.lit('], "version": 3}'))
    return readers.read_vocabularies(spark, as_text(rows, line, "r_regionkey")).select("vocab", "value", F.col("ord").cast("long").alias("ord"))


@query("""WITH o AS (SELECT o_custkey AS c, count(*) AS n, sum(o_totalprice) AS price, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys, max(o_orderkey % 4) AS extra FROM orders GROUP BY o_custkey),
f AS (SELECT c % 40 AS file, count(*) AS n_customers, sum(n)::BIGINT AS n_annotations, sum(extra)::BIGINT AS extra FROM o GROUP BY 1)
SELECT file, CASE WHEN file % 10 = 8 THEN 'error' WHEN file % 10 = 9 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN file % 10 < 8 THEN n_annotations END AS n_annotations, CASE WHEN file % 10 < 8 THEN file END AS pmid, CASE WHEN file % 10 < 8 THEN extra END AS unknown_field FROM f""")
def draft_files(spark, d):
    """Orders as Markdown drafts, a file for each fortieth of the customers; a number
    for a text, a field that the declared shape does not know, broken and absent blocks."""
    o = table(spark, d, "orders").withColumn("file", F.col("o_custkey") % 40)
    note = F.struct(F.lit("genotype").alias("feature_type"), F.col("o_orderkey").cast("string").alias("feature"))
    extra = o.groupBy("file", "o_custkey").agg(F.max(F.col("o_orderkey") % 4).alias("e")).groupBy("file").agg(F.sum("e").alias("extra"))
    by = o.groupBy("file").agg(F.collect_list(note).alias("annotations")).join(extra, "file")
    block = F.to_json(F.struct(F.struct(F.col("file").alias("pmid")).alias("meta"), F.struct("annotations").alias("canto"), F.struct(F.col("extra").alias("deep")).alias("unknown")))
    kind = F.col("file") % 10
    said = F.when(kind == 9, "# No block\n").otherwise(F.concat(F.lit("# Draft\n```json\n"), F.when(kind == 8, "{broken ").otherwise(""), block, F.lit("\n```\nafter\n```json\n{}\n```\n")))
    read = readers.read_drafts(spark, as_text(by.withColumn("part", F.col("file")), said, "part"))
    file = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long")
    count = F.when(F.col("status") == "ok", F.size("draft.canto.annotations").cast("long"))
    return read.select(file.alias("file"), "status", count.alias("n_annotations"), F.col("draft.meta.pmid").cast("long").alias("pmid"), readers.said_field("$.unknown.deep", "long").alias("unknown_field"))
