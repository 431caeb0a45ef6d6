"""Further queries over the driver's tables, each with the same in DuckDB SQL:
extensions, publications, references, figures, captions, tracking lists, cells."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import identifiers, text
from scriptorium.functions.shares import dealt, shares_of
from scriptorium.operators import catalog, documents, drafts, ledger, metering, scoring, tracking, validation
from scriptorium.plans.queries import CAPTIONS, EVENTS, ID_SQL, MATCHES, METER, PARKED, QUERIES, attributed, caption_number, captioned, draft_states, event_ledger, event_stream, line_ids, order_annotations, order_queue, part_index, query, table
from scriptorium.sources.readers import stack_scorecards
from scriptorium.streaming import jobs

# ---- extensions and identifiers ------------------------------------------


@query("""WITH r AS (SELECT p_brand AS relation, arg_min(CASE p_size % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'PHIPO:1' WHEN 2 THEN 'FYPO_EXT:1|%' WHEN 3 THEN 'BTO:1' ELSE 'odd' END, p_partkey) AS range_id FROM part WHERE p_size > 5 GROUP BY p_brand),
v AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'none' ELSE p_brand END AS relation, CASE p_partkey % 4 WHEN 0 THEN 'PHIPO:0000001' WHEN 1 THEN 'BTO:0000002' WHEN 2 THEN '12.5 %' ELSE 'x' END AS value FROM part)
SELECT id, r.range_id IS NOT NULL AS attested, CASE range_id WHEN 'Text' THEN 'free_text' WHEN 'PHIPO:1' THEN 'phipo_term' WHEN 'FYPO_EXT:1|%' THEN 'fypo_ext_term' WHEN 'BTO:1' THEN 'bto_term' WHEN 'odd' THEN 'unknown' END AS kind,
CASE WHEN range_id IS NULL THEN 'unknown relation' WHEN range_id IN ('Text', 'odd') OR (range_id = 'PHIPO:1' AND value LIKE 'PHIPO%') OR (range_id = 'BTO:1' AND value LIKE 'BTO%') OR (range_id = 'FYPO_EXT:1|%' AND value LIKE '12%') THEN 'ok' ELSE 'wrong type' END AS status
FROM v LEFT JOIN r ON v.relation = r.relation""")
def extension_check(spark, d):
    p, n, k = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    range_id = F.when(n % 5 == 0, "Text").when(n % 5 == 1, "PHIPO:1").when(n % 5 == 2, "FYPO_EXT:1|%").when(n % 5 == 3, "BTO:1").otherwise("odd")
    rows = p.where("p_size > 5").select(k.alias("row_no"), F.concat("p_brand", F.lit(" ")).alias("relation"), range_id.alias("range_id"), *[F.lit("x").alias(c) for c in ("display", "types", "domain", "cardinality")])
    value = F.when(k % 4 == 0, " PHIPO:0000001").when(k % 4 == 1, "BTO:0000002").when(k % 4 == 2, "12.5 %").otherwise("x")
    pairs = p.select(k.alias("id"), F.when(n % 7 == 0, "none").otherwise(F.col("p_brand")).alias("relation"), value.alias("value"))
    return validation.extension_check(pairs, validation.relation_rollup(rows)).select("id", "attested", "kind", "status")


@query(f"""WITH {ID_SQL}, u AS (SELECT l_orderkey, l_linenumber, p, local FROM ids),
x AS (SELECT *, CASE WHEN p = 'XX' THEN 'unknown_prefix' WHEN length(local) <> (CASE WHEN p = 'MOD' THEN 5 ELSE 7 END) THEN 'format_invalid' WHEN p = 'MOD' THEN NULL WHEN p_partkey IS NULL THEN 'not_found' WHEN p_size > 45 THEN 'obsolete' END AS bad
  FROM u LEFT JOIN part ON CAST(local AS BIGINT) = p_partkey)
SELECT l_orderkey, l_linenumber, CASE WHEN p = 'XX' THEN 'XX:' ELSE p || ':' END || local AS term_id, bad AS bad_term FROM x""")
def bad_terms(spark, d):
    """Ids of lines as terms of annotations, each checked once, whatever index rows repeat."""
    index = part_index(spark, d)
    return validation.with_bad_terms(line_ids(spark, d).withColumnRenamed("input_id", "term_id"), index.unionByName(index), ("GO", "BTO")).select("l_orderkey", "l_linenumber", "term_id", "bad_term")


@query("""WITH h AS (SELECT p_name AS id, row_number() OVER (PARTITION BY p_name ORDER BY (p_size % 3 <> 0), p_partkey) AS n, p_size % 3 = 0 AS defining, p_brand AS label FROM part WHERE p_size < 40),
a AS (SELECT DISTINCT p_name AS id FROM part UNION SELECT 'nothing')
SELECT a.id AS term_id, label, CASE WHEN n IS NULL THEN 'not_found' WHEN defining THEN 'defining' ELSE 'first' END AS status FROM a LEFT JOIN h ON a.id = h.id AND n = 1""")
def defining_term(spark, d):
    p = table(spark, d, "part")
    hits = p.where("p_size < 40").select(F.upper("p_name").alias("term_id"), F.col("p_brand").alias("label"), (F.col("p_size") % 3 == 0).alias("defining"), F.col("p_partkey").alias("place"))
    asked = p.select(F.col("p_name").alias("term_id")).unionByName(spark.range(1).select(F.lit("nothing").alias("term_id"))).distinct()
    return validation.defining_terms(asked, hits)


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey AS place, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'SRC' END AS source, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS pmid, 'PMC' || o_custkey AS pmcid FROM orders WHERE o_orderstatus <> 'P'),
k AS (SELECT 'pmid' AS kind, pmid AS key, id, source, place FROM r WHERE pmid IS NOT NULL UNION ALL SELECT 'pmcid', pmcid, id, source, place FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY place) AS n, count(*) OVER (PARTITION BY kind, key) AS hits FROM k),
q AS (SELECT c_custkey AS c, CASE c_custkey % 4 WHEN 0 THEN 'pmid' WHEN 1 THEN 'pmcid' WHEN 2 THEN 'doi' ELSE 'error' END AS kind, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'PMC' || c_custkey WHEN 2 THEN '10.1234/x' || c_custkey END AS key FROM customer)
SELECT c AS asked, q.kind, CASE q.kind WHEN 'pmid' THEN 'EXT_ID:' || q.key WHEN 'pmcid' THEN 'PMCID:' || q.key WHEN 'doi' THEN 'DOI:' || q.key END AS query, coalesce(hits, 0) AS n_hits, CASE WHEN id IS NOT NULL THEN (CASE WHEN source = '' THEN 'MED' ELSE source END) || ':' || id END AS ref,
greatest(least(coalesce(hits, 0) - 1, 4), 0) AS n_others, CASE WHEN q.kind = 'error' THEN 'error' WHEN hits IS NULL THEN 'not_found' WHEN hits > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM q LEFT JOIN n ON q.kind = n.kind AND q.key = n.key AND n.n = 1""")
def publication_lookup(spark, d):
    o, k, c = table(spark, d, "orders").where("o_orderstatus <> 'P'"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    records = o.select(k.alias("id"), k.alias("place"), F.when(k % 3 == 0, "").otherwise("SRC").alias("source"), F.when(F.col("o_orderstatus") == "F", c).alias("pmid"), F.concat(F.lit("pmc"), c).alias("pmcid"), F.lit(None).cast("string").alias("doi"))
    n = F.col("c_custkey")
    given = F.when(n % 4 == 0, F.concat(F.lit(" "), n.cast("string"))).when(n % 4 == 1, F.concat(F.lit("pmc"), n.cast("string"))).when(n % 4 == 2, F.concat(F.when(n % 8 == 2, "doi:").otherwise(""), F.lit("10.1234/x"), n.cast("string"))).otherwise("unknown")
    found = validation.publication_records(table(spark, d, "customer").select(n.alias("asked"), given.alias("identifier")), records)
    return found.select("asked", "kind", "query", "n_hits", "ref", F.size("other_hits").cast("long").alias("n_others"), "status")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'archive' WHEN 2 THEN 'empty' ELSE 'other' END AS kind FROM pages""")
def payload_kinds(spark, d):
    n = F.col("page_id")
    said = F.when(n % 5 == 0, F.concat(F.lit(" \n<?xml version='1.0'?><errorBean>"), "url")).when(n % 5 == 1, F.concat(F.lit("PK"), "html")).when(n % 5 == 2, "").when(n % 5 == 3, F.concat(F.lit("<?xml?>"), "url")).otherwise(F.concat(F.lit("<p>"), "html"))
    return table(spark, d, "pages").select("page_id", validation.payload_kind(F.encode(said, "utf-8")).alias("kind"))


@query("""WITH v AS (SELECT p_brand AS type, l_returnflag || p_type AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT DISTINCT p_brand AS type, 'A' || p_type || (CASE WHEN p_size % 2 = 0 THEN 'X' ELSE '' END) AS code FROM part WHERE p_size < 20),
b AS (SELECT v.* FROM v WHERE type IN (SELECT type FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.type = v.type AND c.code = v.value))
SELECT b.type, b.value, b.n, least(count(c.code), 3) AS n_near, min(c.code) AS nearest FROM b LEFT JOIN c ON b.type = c.type AND ((length(b.value) >= 5 AND contains(lower(c.code), lower(b.value))) OR (length(c.code) >= 5 AND contains(lower(b.value), lower(c.code)))) GROUP BY b.type, b.value, b.n""")
def bad_evidence(spark, d):
    """Values that a type's list does not have, with the codes that hold them or that they hold."""
    part = table(spark, d, "part")
    values = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("type"), F.concat("l_returnflag", "p_type").alias("value"))
    code = F.concat(F.lit("A"), "p_type", F.when(F.col("p_size") % 2 == 0, "X").otherwise(""))
    out = validation.bad_codes(values, part.where("p_size < 20").select(F.col("p_brand").alias("type"), code.alias("code")))
    return out.select("type", "value", "n", F.size("suggestions").cast("long").alias("n_near"), F.try_element_at("suggestions", F.lit(1)).alias("nearest"))


ASSERTED = r"""a AS (SELECT DISTINCT l_orderkey AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'GO:' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') WHEN 1 THEN 'UniProtKB:P' || l_suppkey ELSE 'FYPO:ABC' || l_suppkey END AS id FROM lineitem WHERE l_linenumber < 6)"""


@query(f"WITH {ASSERTED} SELECT doc, count(*) AS n_ids, min(id) AS first_id FROM a GROUP BY doc")
def asserted(spark, d):
    """Ids that texts assert, in several spellings, emphasised within; those of other
    case or prefix don't count."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    said = F.when(n % 3 == 0, F.concat(F.lit("**GO:**`"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("`"))).when(n % 3 == 1, F.concat(F.when(n == 1, "UniProt:").otherwise("UniProtKB:"), F.lit("p"), s)).otherwise(F.concat(F.lit("FYPO:abc"), s))
    said = F.when(n < 6, said).otherwise(F.concat(F.lit("go:"), s))
    texts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.concat_ws("; ", F.collect_list(said)).alias("text"))
    found = identifiers.asserted_ids(F.col("text"))
    return texts.select("doc", F.size(found).cast("long").alias("n_ids"), F.try_element_at(found, F.lit(1)).alias("first_id")).where("n_ids > 0")


# ---- drafts --------------------------------------------------------------

USED = r"""
g AS (SELECT DISTINCT l_orderkey AS draft, 'g' || l_linenumber AS name, CASE WHEN l_linenumber = 4 THEN 'Host plant' ELSE 'pathogen' END AS role FROM lineitem),
m AS (SELECT o_orderkey AS draft, CASE WHEN o_orderkey % 2 = 0 THEN 'g1' END AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'g2' END AS h FROM orders),
r AS (SELECT o_orderkey AS draft, 'g3' AS name FROM orders WHERE o_orderkey % 5 = 0 UNION SELECT o_orderkey, 'g4' FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT o_orderkey, 'g5' FROM orders WHERE o_orderkey % 7 = 0),
x AS (SELECT g.*, p IS NOT NULL AND p = name AS isp, h IS NOT NULL AND h = name AS ish, EXISTS (SELECT 1 FROM r WHERE r.draft = g.draft AND r.name = g.name) AS isr FROM g JOIN m ON g.draft = m.draft)"""


def genotype_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, k, n = table(spark, d, "orders"), F.col("o_orderkey"), F.col("l_linenumber")
    genotypes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft"), F.concat(F.lit("g"), n.cast("string")).alias("name"), F.when(n == 4, "Host plant").otherwise("pathogen").alias("role")).distinct()
    metas = o.select(k.alias("draft"), F.when(k % 2 == 0, "g1").alias("pathogen_genotype"), F.when(k % 3 == 0, " g2").alias("host_genotype"))
    pair = lambda r, v: F.struct(F.lit(r).alias("relation"), F.lit(v).alias("value"))
    controls = F.when(k % 7 == 0, F.array(pair("assayed_using", "g6"), pair("compared_to_control", "g4; g5")))
    return genotypes, metas, o.select(k.alias("draft"), F.when(k % 5 == 0, "g3").alias("feature"), controls.alias("extensions"))


@query(f"""WITH {USED} SELECT draft, name, CASE WHEN NOT isp AND NOT ish AND NOT isr THEN 'unused' WHEN (ish OR role LIKE 'Host%') AND NOT ish AND NOT isr THEN 'unused' WHEN NOT (ish OR role LIKE 'Host%') AND NOT isp THEN 'no metagenotype' ELSE 'ok' END AS usage FROM x""")
def genotype_usage(spark, d):
    return drafts.genotype_usage(*genotype_tables(spark, d)).select("draft", "name", "usage")


@query(f"WITH {USED} SELECT draft, name, CASE WHEN ish THEN 'host' WHEN isp THEN 'pathogen' END AS role FROM x")
def genotype_roles(spark, d):
    genotypes, metas, _ = genotype_tables(spark, d)
    return drafts.genotype_roles(genotypes, metas.withColumn("host_genotype", F.trim("host_genotype"))).select("draft", "name", "role")


@query("WITH r AS (SELECT DISTINCT l_orderkey AS draft, l_returnflag AS name FROM lineitem UNION SELECT l_orderkey, l_linestatus FROM lineitem UNION SELECT l_orderkey, 'x' || l_linenumber FROM lineitem) SELECT draft, count(*) AS n, min(name) AS first FROM r GROUP BY draft")
def reference_sets(spark, d):
    line = table(spark, d, "lineitem")
    pair = F.struct(F.lit("compared_to_control").alias("relation"), F.concat("l_linestatus", F.lit(" ; ;x"), F.col("l_linenumber").cast("string")).alias("value"))
    rows = line.select(F.col("l_orderkey").alias("draft"), F.col("l_returnflag").alias("feature"), F.array(pair).alias("extensions"))
    return drafts.annotation_references(rows).groupBy("draft").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 3 <> 2 END AS named FROM customer""")
def naming_rule(spark, d):
    """Genotypes named by an allele, by its stem within brackets of any depth, or by neither."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Strain 7 Δ"), F.lit("geneA"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("x-Pt"), k.cast("string"), F.lit("(FL)-OE"))).otherwise("isolate")
    alleles = F.when(k % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit("geneA"), k.cast("string"), F.lit("([a(b[c(d[e]f)]g)h])Δ")), F.concat(F.lit("Pt"), k.cast("string"), F.lit("(FL)"))))
    return table(spark, d, "customer").select("c_custkey", text.named_by_allele(name, alleles).alias("named"))


@query(f"""WITH {PARKED}, s AS (SELECT o_orderkey AS draft, CASE WHEN o_orderkey % 4 = 2 THEN 'phenotype' END AS lost FROM orders)
SELECT q.draft, CASE WHEN reason = '' AND lost IS NOT NULL THEN 'no section' ELSE reason END AS reason, CASE WHEN reason = '' AND lost IS NULL THEN 'enter' ELSE 'parked' END AS disposition FROM q JOIN s ON q.draft = s.draft""")
def queue_sections(spark, d):
    """Annotations of a type that no section takes are parked as well."""
    _, genotypes = draft_states(spark, d)
    states = genotypes.select("draft", F.lit("genotype").alias("feature_type"), "name", "problem")
    rows = order_annotations(spark, d).withColumn("type", F.when(F.col("draft") % 4 == 2, "other").otherwise(F.col("type")))
    return drafts.queue_items(rows, states, ("physical_interaction", "molecular_function", "phenotype"), shares_of(rows), ("draft",)).select("draft", "reason", "disposition")


@query(f"""WITH {PARKED}, gn AS (SELECT l_orderkey AS draft, l_suppkey AS g, max(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) AS held FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey),
gc AS (SELECT draft, sum(1 - held)::BIGINT AS e, sum(held)::BIGINT AS h FROM gn GROUP BY draft), qc AS (SELECT draft, sum(CASE WHEN reason = '' THEN 1 ELSE 0 END)::BIGINT AS e, sum(CASE WHEN reason = '' THEN 0 ELSE 1 END)::BIGINT AS p FROM q GROUP BY draft)
SELECT qc.draft, qc.e AS n_enter, p AS n_parked, coalesce(gc.e, 0) AS n_genes_enter, coalesce(h, 0) AS n_genes_held FROM qc LEFT JOIN gc ON qc.draft = gc.draft""")
def queue_summary(spark, d):
    held = F.when(F.col("s_acctbal") < 0, "").otherwise("P1")
    line = table(spark, d, "lineitem")
    genes = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("draft"), F.col("l_suppkey").alias("name"), held.alias("accession"))
    shares = shares_of(line)
    return drafts.queue_counts(order_queue(spark, d), drafts.gene_state(dealt(genes, shares, "draft").distinct()), shares)


@query(r"""SELECT o_orderkey AS draft, CASE WHEN o_orderstatus = 'P' THEN '⚠ ' || (CASE WHEN o_custkey % 2 = 0 THEN 'a\|b c' ELSE '(unresolved)' END) ELSE (CASE WHEN o_custkey % 2 = 0 THEN 'a\|b c — GO:1' ELSE 'GO:1' END) END AS term,
'r=' || o_custkey || ' · s=1' AS extensions, 'I' || o_custkey || '; J' AS interactor FROM orders""")
def queue_cells(spark, d):
    c = F.col("o_custkey").cast("string")
    pair = lambda r, v: F.struct(F.lit(r).alias("relation"), v.alias("value"))
    ext = F.array(pair(" r ", c), pair("interactor", F.concat(F.lit("I"), c)), pair(None, c), pair("s", F.lit("1")), pair("interactor", F.lit("J")))
    term = text.term_cell(F.when(F.col("o_orderstatus") != "P", "GO:1"), F.when(F.col("o_custkey") % 2 == 0, "a|b\n  c"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("draft"), term.alias("term"), text.extensions_text(ext, ("interactor",)).alias("extensions"), text.extension_values(ext, "interactor").alias("interactor"))


# ---- documents -----------------------------------------------------------


def figure_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Lines of orders as figures: cited in texts, listed with their sizes, read or not;
    and the number of shares for them."""
    n = F.col("l_linenumber")
    stored = table(spark, d, "lineitem")
    shares = shares_of(stored)
    line = dealt(stored.select(F.col("l_orderkey").alias("doc"), n.alias("n"), "l_partkey"), shares, "doc", "n").distinct()
    label = F.concat(F.lit("Figure "), F.col("n").cast("string"))
    cited = line.where("n <= 4").select("doc", F.explode(text.figure_labels(F.concat(F.lit("Fig. "), F.col("n").cast("string"), F.lit("A,B; see figure "), (F.col("n") + 1).cast("string"))))).toDF("doc", "label").withColumn("required", F.col("label") == "Figure 2")
    one = line.select("doc", "n").distinct()
    roster = one.where("n <> 5").select("doc", text.figure_label(F.concat(F.lit(" fig "), F.col("n").cast("string"), F.lit("C"))).alias("label"), (F.col("n") != 4).alias("openable"), text.image_tokens(F.col("n") * 500, F.lit(1000)).alias("tokens"))
    log = one.where("n % 3 = 0").select("doc", label.alias("label"), F.lit(True).alias("inspected"), F.lit("seen").alias("read"), F.lit(None).cast("string").alias("note"))
    return roster, log, cited, shares


FIGURES = r"""one AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n FROM lineitem), rows_ AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n, l_partkey FROM lineitem),
cit AS (SELECT doc, n, count(*) AS k FROM (SELECT doc, n FROM rows_ WHERE n <= 4 UNION ALL SELECT doc, n + 1 FROM rows_ WHERE n <= 4) x GROUP BY doc, n),
ros AS (SELECT doc, n, CASE n WHEN 1 THEN 667 WHEN 2 THEN 1333 WHEN 3 THEN 1533 WHEN 4 THEN 1533 WHEN 6 THEN CAST(round_even(1568 * (1000 * 1568 / 3000.0) / 750, 0) AS BIGINT) WHEN 7 THEN CAST(round_even(1568 * (1000 * 1568 / 3500.0) / 750, 0) AS BIGINT) END AS tokens FROM one WHERE n <> 5),
fg AS (SELECT coalesce(cit.doc, ros.doc) AS doc, coalesce(cit.n, ros.n) AS n, coalesce(k, 0) AS k, coalesce(tokens, 0) AS tokens FROM cit FULL JOIN ros ON cit.doc = ros.doc AND cit.n = ros.n),
pl AS (SELECT fg.doc, fg.n, k, tokens, CASE WHEN k = 0 THEN 'not needed' WHEN fg.n % 3 = 0 AND one.n IS NOT NULL THEN 'read' WHEN fg.n = 2 THEN 'required' ELSE 'pending' END AS state FROM fg LEFT JOIN one ON fg.doc = one.doc AND fg.n = one.n)"""


@query(f"WITH {FIGURES} SELECT doc, 'Figure ' || n AS label, row_number() OVER (PARTITION BY doc ORDER BY n) AS place, k AS n_cited, state, tokens FROM pl")
def figure_plan(spark, d):
    return documents.reading_plan(*figure_tables(spark, d)).withColumns({c: F.col(c).cast("long") for c in ("place", "n_cited", "tokens")})


@query(f"WITH {FIGURES} SELECT doc, sum(CASE WHEN state IN ('pending', 'required') THEN tokens ELSE 0 END)::BIGINT AS pending_tokens, sum(CASE WHEN state = 'required' THEN tokens ELSE 0 END)::BIGINT AS required_tokens, sum(CASE WHEN state = 'not needed' THEN tokens ELSE 0 END)::BIGINT AS not_needed_tokens FROM pl GROUP BY doc")
def figure_costs(spark, d):
    return documents.reading_costs(documents.reading_plan(*figure_tables(spark, d)))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, regexp_replace(line, '^[\t\n\x0b\x0c\r \x{85}\pZ]+|[\t\n\x0b\x0c\r \x{85}\pZ]+$', '', 'g') AS s FROM l), n AS (SELECT doc_id, count(CASE WHEN length(s) > 3 THEN 1 END) AS n, coalesce(sum(CASE WHEN length(s) > 3 THEN length(s) END), 0)::BIGINT AS m FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n.n = 0 THEN 0 ELSE n.m + 2 * (n.n - 1) END AS n_letters FROM documents d JOIN n ON d.doc_id = n.doc_id""")
def section_cleaning(spark, d):
    """Whole texts below a head that names them, with page marks between."""
    whole = F.concat(F.lit("\n 2. METHODS and so on\n\n--- PAGE 1 ---\n"), "text", F.lit("\n--- PAGE 2 ---\nabc\n"))
    return table(spark, d, "documents").select("doc_id", F.length(documents.section_text(whole, F.lit("Methods"))).cast("long").alias("n_letters"))


MEDIA = CAPTIONS + r""", md AS (SELECT doc, kind, number FROM cl WHERE i % 2 = 0),
mc AS (SELECT md.doc, md.kind, md.number, CASE WHEN cap.doc IS NULL THEN 'no caption' ELSE 'captioned' END AS status FROM md LEFT JOIN cap ON md.doc = cap.doc AND md.kind = cap.kind AND md.number = cap.number
  UNION ALL SELECT doc, kind, number, 'uncovered' FROM cap WHERE kind = 'table' AND NOT EXISTS (SELECT 1 FROM md WHERE md.doc = cap.doc AND md.kind = cap.kind AND md.number = cap.number))"""


def media_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = captioned(spark, d)
    lines = F.filter(F.split("text", "\n\n"), lambda x: x != "")
    every = docs.select("doc", F.posexplode(lines).alias("i", "line")).where("i % 2 = 0")
    return every.select("doc", F.when(F.col("i") % 3 == 0, "table").otherwise("figure").alias("kind"), caption_number(F.col("i")).alias("number")), documents.best_captions(documents.captions(docs))


@query(f"WITH {MEDIA} SELECT doc, kind, number, status FROM mc")
def media_captions(spark, d):
    media, found = media_tables(spark, d)
    return documents.media_captions(media, found).select("doc", "kind", "number", "status")


@query(f"""WITH {MEDIA}, a AS (SELECT doc, sum((status <> 'uncovered')::INT)::BIGINT AS n_media, sum((status = 'captioned')::INT)::BIGINT AS n_captioned, sum((status = 'uncovered')::INT)::BIGINT AS n_uncovered FROM mc GROUP BY doc), b AS (SELECT doc, sum((confidence > 0.8)::INT)::BIGINT AS n_sure FROM cap GROUP BY doc),
s AS (SELECT doc_id AS doc, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT s.doc, coalesce(n_media, 0) AS n_media, coalesce(n_captioned, 0) AS n_captioned, coalesce(n_uncovered, 0) AS n_uncovered, coalesce(n_sure, 0) AS n_sure, 1 AS n_sections, (n > 100)::BIGINT AS n_with_content FROM s LEFT JOIN a ON s.doc = a.doc LEFT JOIN b ON s.doc = b.doc""")
def conversion_quality(spark, d):
    media, found = media_tables(spark, d)
    sections = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return documents.conversion_quality(media, found, sections)


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n FROM lineitem), im AS (SELECT doc, n AS image, n % 2 AS page, 100 * n AS top, 100 * n + 60 AS bottom, CASE WHEN n = 3 THEN 40 ELSE 80 END AS w FROM b),
ca AS (SELECT doc, n AS number, n % 2 AS page, CASE WHEN n % 3 = 0 THEN 'table' ELSE 'figure' END AS kind, 100 * n + 62 AS ct, 100 * n + 70 AS cb FROM b WHERE n <> 2),
g AS (SELECT im.doc, image, kind, number, CASE WHEN kind = 'table' THEN top - cb ELSE ct - bottom END AS gap FROM im JOIN ca ON im.doc = ca.doc AND im.page = ca.page WHERE w >= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, image ORDER BY gap, number, kind) AS k FROM g WHERE gap BETWEEN -5 AND 220)
SELECT im.doc, im.image, kind, number, CAST(gap AS BIGINT) AS gap, CASE WHEN kind IS NOT NULL THEN 'captioned' WHEN w < 50 THEN 'small' ELSE 'no caption' END AS status FROM im LEFT JOIN r ON im.doc = r.doc AND im.image = r.image AND k = 1""")
def nearest_caption(spark, d):
    n = F.col("l_linenumber")
    one = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("n")).distinct()
    k = F.col("n")
    images = one.select("doc", k.alias("image"), (k % 2).alias("page"), (100 * k).alias("top"), (100 * k + 60).alias("bottom"), F.when(k == 3, 40).otherwise(80).alias("width"), F.lit(60).alias("height"))
    found = one.where("n <> 2").select("doc", k.alias("number"), (k % 2).alias("page"), F.when(k % 3 == 0, "table").otherwise("figure").alias("kind"), (100 * k + 62).alias("caption_top"), (100 * k + 70).alias("caption_bottom"))
    return documents.nearest_captions(images, found).withColumn("gap", F.col("gap").cast("long"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n FROM lineitem), f AS (SELECT doc, n, count(*) AS k FROM (SELECT doc, n FROM r WHERE n % 2 = 0 UNION ALL SELECT doc, n FROM r WHERE n % 3 = 0) x GROUP BY doc, n)
SELECT r.doc, 'img/f' || r.n || '.tif' AS href, coalesce(k, 0) AS n_files FROM r LEFT JOIN f ON r.doc = f.doc AND r.n = f.n""")
def graphics_audit(spark, d):
    n = F.col("l_linenumber")
    one = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), n.cast("string").alias("s"), n.alias("n")).distinct()
    files = one.where("n % 2 = 0").select("doc", F.concat(F.lit("/a/f"), "s", F.lit(".jpg")).alias("path")).unionByName(one.where("n % 3 = 0").select("doc", F.concat(F.lit("f"), "s", F.lit(".png")).alias("path")))
    return documents.graphics_audit(one.select("doc", F.concat(F.lit("img/f"), "s", F.lit(".tif")).alias("href")), files).select("doc", "href", "n_files")


@query("WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 1)), ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS alike FROM w")
def word_overlap(spark, d):
    other = F.concat_ws("  ", "p_type", F.substring_index("p_name", " ", 1))
    return table(spark, d, "part").select("p_partkey", F.round(text.word_jaccard(F.col("p_name"), other), 6).alias("alike"))


# ---- tracking ------------------------------------------------------------

ART = """art AS (SELECT o_orderkey AS article_id, CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'curated' WHEN 3 THEN 'reviewed' WHEN 4 THEN 'published' ELSE 'lost' END AS status,
  CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 20 END AS curator, CASE o_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS priority, o_custkey % 30 + 1990 AS pub_year FROM orders)"""


def tracked(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.coalesce(F.try_element_at(F.array(*map(F.lit, tracking.STATUSES)), (k % 6 + 1).cast("int")), F.lit("lost"))
    return table(spark, d, "orders").select(k.alias("article_id"), status.alias("status"), F.when(c % 4 != 0, c % 20).alias("curator"), F.when(c % 3 == 0, "low").when(c % 3 == 1, "medium").otherwise("high").alias("priority"), (c % 30 + 1990).alias("pub_year"), F.concat(F.lit("t"), k.cast("string")).alias("title"))


def named_suppliers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("protein_id"), F.col("s_name").alias("gene_name"), F.when(k % 6 == 0, " ").when(k % 5 != 0, "P1").alias("uniprot_id"))


@query(f"WITH {ART} SELECT 'no accession' AS kind, s_suppkey AS id FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 6 = 0 UNION ALL SELECT 'no curator', article_id FROM art WHERE status = 'queued' AND curator IS NULL UNION ALL SELECT 'attention', article_id FROM art WHERE status IN ('queued', 'in_progress')")
def gaps_attention(spark, d):
    return tracking.data_gaps(tracked(spark, d), named_suppliers(spark, d))


LISTED = ART + """, men AS (SELECT l_orderkey AS a, count(*) AS n, string_agg(s_name, ', ' ORDER BY s_name) AS p FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 9 <> 0 GROUP BY l_orderkey),
lst AS (SELECT art.*, coalesce(n, 0) AS n_mentions, coalesce(p, CASE WHEN n IS NOT NULL THEN '' END) AS proteins, CASE status WHEN 'in_progress' THEN 1 WHEN 'queued' THEN 2 WHEN 'curated' THEN 3 WHEN 'reviewed' THEN 4 WHEN 'published' THEN 5 ELSE 6 END AS sp FROM art LEFT JOIN men ON article_id = a)"""


def listing(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("protein_id"))
    return tracking.article_listing(tracked(spark, d), mentions, named_suppliers(spark, d).where("protein_id % 9 <> 0"))


@query(f"WITH {LISTED} SELECT article_id, status, n_mentions, proteins FROM lst")
def article_listing(spark, d):
    return listing(spark, d).select("article_id", "status", "n_mentions", "proteins")


@query(f"WITH {LISTED} SELECT article_id, row_number() OVER (ORDER BY sp, priority DESC, pub_year DESC, article_id) AS place FROM lst QUALIFY place <= 15")
def article_heads(spark, d):
    """The first fifteen of the list: a top-k report."""
    return tracking.first_rows(listing(spark, d), tracking.listing_order(), 15).select("article_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {ART} SELECT status, count(*) AS n, CASE status WHEN 'in_progress' THEN 1 WHEN 'queued' THEN 2 WHEN 'curated' THEN 3 WHEN 'reviewed' THEN 4 WHEN 'published' THEN 5 ELSE 6 END AS place FROM art GROUP BY status")
def status_totals(spark, d):
    return tracking.status_totals(tracked(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("""WITH p AS (SELECT * FROM (VALUES ('today', 0), ('week', 7), ('long', 400), ('ahead', -9999)) v(period, days)), s AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS i, l_tax AS h FROM lineitem)
SELECT period, count(day) AS n_sessions, coalesce(sum(q), 0)::BIGINT AS proteins, coalesce(sum(i), 0)::BIGINT AS interactions, coalesce(round(sum(h), 6), 0) AS hours FROM p LEFT JOIN s ON day >= DATE '1998-01-01' - days::INT GROUP BY period""")
def recent(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("session_date"), F.col("l_quantity").cast("long").alias("proteins"), F.col("l_linenumber").cast("long").alias("interactions"), F.col("l_tax").alias("hours"))
    return tracking.period_totals(s, dt.date(1998, 1, 1), {"today": 0, "week": 7, "long": 400, "ahead": -9999}).withColumn("hours", F.round("hours", 6))


@query("""SELECT l_orderkey AS article_id, l_suppkey AS protein_id, s_name AS gene_name, CASE WHEN o_orderkey IS NOT NULL THEN 't' || o_orderkey END AS title, concat_ws(', ', CASE WHEN s_name IS NULL THEN 'protein' END, CASE WHEN o_orderkey IS NULL THEN 'article' END) AS missing
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 9 <> 0 LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 8 <> 0""")
def mention_details(spark, d):
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("protein_id"))
    return tracking.mention_details(mentions, named_suppliers(spark, d).where("protein_id % 9 <> 0"), tracked(spark, d).where("article_id % 8 <> 0"))


@query(f"""WITH {ART}, keys AS (SELECT o_custkey AS k, count(*) - 1 AS m FROM orders GROUP BY o_custkey), pairs AS (SELECT count(*) - 1 AS m FROM lineitem GROUP BY l_suppkey, l_orderkey),
s AS (SELECT l_shipdate AS day, l_linenumber, CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END AS curator, l_orderkey + (CASE WHEN l_partkey % 50 = 0 THEN 1000000000 ELSE 0 END) AS article FROM lineitem)
SELECT 'articles' AS relation, 'status not allowed' AS problem, sum((status = 'lost')::INT)::BIGINT AS n FROM art UNION ALL SELECT 'articles', 'priority not allowed', 0 UNION ALL SELECT 'articles', 'title missing', 0
UNION ALL SELECT 'articles', 'pmid repeated', sum(m)::BIGINT FROM keys
UNION ALL SELECT 'species', 'name missing', 0 UNION ALL SELECT 'species', 'type missing', sum((n_regionkey = 3)::INT)::BIGINT FROM nation UNION ALL SELECT 'species', 'type not allowed', sum((n_regionkey = 2)::INT)::BIGINT FROM nation
UNION ALL SELECT 'proteins', 'protein_type not allowed', sum((s_suppkey % 5 = 4)::INT)::BIGINT FROM supplier UNION ALL SELECT 'proteins', 'species_id leads nowhere', sum((s_suppkey % 7 = 0)::INT)::BIGINT FROM supplier
UNION ALL SELECT 'curation_sessions', 'session_date missing', sum((l_linenumber = 7)::INT)::BIGINT FROM s UNION ALL SELECT 'curation_sessions', 'curator missing', sum((curator IS NULL)::INT)::BIGINT FROM s
UNION ALL SELECT 'curation_sessions', 'article_id leads nowhere', sum((article NOT IN (SELECT o_orderkey FROM orders))::INT)::BIGINT FROM s
UNION ALL SELECT 'protein_article_mentions', 'experimental_evidence not allowed', sum((l_returnflag = 'R')::INT)::BIGINT FROM lineitem UNION ALL SELECT 'protein_article_mentions', 'protein_id, article_id repeated', sum(m)::BIGINT FROM pairs
UNION ALL SELECT 'protein_article_mentions', 'protein_id leads nowhere', sum((l_suppkey NOT IN (SELECT s_suppkey FROM supplier))::INT)::BIGINT FROM lineitem
UNION ALL SELECT 'protein_article_mentions', 'article_id leads nowhere', sum((l_orderkey NOT IN (SELECT o_orderkey FROM orders))::INT)::BIGINT FROM lineitem""")
def relation_checks(spark, d):
    """All five relations of the tracking store."""
    line, k = table(spark, d, "lineitem"), F.col("s_suppkey")
    pmid = table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").cast("string").alias("pmid"))
    kind = F.when(F.col("n_regionkey") == 2, "vector").when(F.col("n_regionkey") == 3, None).when(F.col("n_regionkey") == 1, "pathogen").otherwise("host")
    protein_type = F.coalesce(F.try_element_at(F.array(*map(F.lit, ("effector", "resistance", "virulence", "other"))), (k % 5 + 1).cast("int")), F.lit("enzyme"))
    evidence = F.when(F.col("l_returnflag") == "R", "unclear").when(F.col("l_returnflag") == "A", "knockout").otherwise("other")
    relations = {
        "species": table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), kind.alias("type")),
        "articles": tracked(spark, d).join(pmid, "article_id").withColumnRenamed("article_id", "id"),
        "proteins": table(spark, d, "supplier").select(k.alias("id"), (F.col("s_nationkey") + F.when(k % 7 == 0, 1000).otherwise(0)).alias("species_id"), protein_type.alias("protein_type")),
        "curation_sessions": line.select(
            F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("session_date"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey").cast("string")).alias("curator"),
            (F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 0, 1_000_000_000).otherwise(0)).alias("article_id"),
        ),
        "protein_article_mentions": line.select(F.col("l_suppkey").alias("protein_id"), F.col("l_orderkey").alias("article_id"), evidence.alias("experimental_evidence")),
    }
    out = None
    for name, rows in relations.items():
        part = tracking.relation_errors(name, rows, relations)
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH t AS (SELECT c_custkey AS pmid FROM customer WHERE c_acctbal > 0), r AS (SELECT o_custkey AS pmid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT pmid, 'there' AS disposition, 1 AS n FROM t UNION ALL SELECT pmid, CASE WHEN n > 1 OR pmid IN (SELECT pmid FROM t) THEN 'rejected' ELSE 'inserted' END AS disposition, count(*) FROM r GROUP BY 1, 2""")
def insert_rows(spark, d):
    have = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("pmid"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("pmid"), F.col("o_orderkey").alias("seq"))
    return tracking.inserted(have, new, ["pmid"]).groupBy("pmid", "disposition").agg(F.count(F.lit(1)).alias("n"))


REPORTS = r"""rp AS (SELECT o_orderkey AS seq, o_custkey AS pmid, CASE o_orderkey % 3 WHEN 0 THEN 'jats-publisher' WHEN 1 THEN 'pdf' END AS route, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false END AS seen FROM orders),
la AS (SELECT pmid, arg_max(seq, seq) AS seq FROM rp WHERE pmid IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY pmid)"""


def reported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    arts = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("article_id"), F.col("c_custkey").cast("string").alias("pmid"), F.lit("").alias("note_path"), F.lit(None).cast("string").alias("title"))
    rows = table(spark, d, "orders").select(k.alias("seq"), F.col("o_custkey").cast("string").alias("pmid"), F.lit("").alias("note_path"), F.lit("none").alias("title"), F.when(k % 3 == 0, " JATS").when(k % 3 == 1, "pdf").alias("route"), F.lit("f.x").alias("source_file"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("inspected"), (k % 5).alias("figures_read"), F.lit(6).alias("figures_total"))
    return tracking.attach_provenance(arts, rows)


@query(f"""WITH {REPORTS} SELECT c_custkey AS article_id, route AS source_route, CASE WHEN route IS NOT NULL THEN coalesce(seen, route = 'pdf')::INT END AS figures_available, rp.seq % 5 AS figures_inspected FROM customer LEFT JOIN la ON la.pmid = c_custkey LEFT JOIN rp ON rp.seq = la.seq WHERE c_acctbal > 0""")
def provenance(spark, d):
    return reported(spark, d)[0].select("article_id", "source_route", "figures_available", "figures_inspected")


@query("SELECT o_orderkey AS seq, CASE WHEN c_custkey IS NULL THEN 'no article' ELSE 'attached' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def provenance_reports(spark, d):
    return reported(spark, d)[1].select("seq", "status")


@query("SELECT o_orderkey AS draft, 'tool' || (CASE WHEN o_custkey % 2 = 0 THEN ' · m' || o_custkey ELSE '' END) || (CASE WHEN o_orderkey % 3 = 0 THEN ' · commit abc' ELSE '' END) || ' · date ' || (CASE WHEN o_orderkey % 5 = 0 THEN '2020-02-02' ELSE '2024-01-01' END) AS stamp FROM orders")
def stamps(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = text.stamp("tool", F.when(c % 2 == 0, F.concat(F.lit(" m"), c.cast("string"))), F.when(k % 5 == 0, "2020-02-02"), F.when(k % 3 == 0, "abc"), F.to_date(F.lit("2024-01-01")))
    return table(spark, d, "orders").select(k.alias("draft"), made.alias("stamp"))


# ---- metering, scores, orders --------------------------------------------


@query("""WITH r AS (SELECT o_custkey AS pmid, o_orderkey AS session, CAST(floor(o_totalprice) AS BIGINT) AS ov, o_orderkey % 4 AS n, o_custkey * 10 AS dr, o_orderdate FROM orders)
SELECT pmid, session, round_even(ov / greatest(n, 1), 0)::BIGINT AS overhead_share, dr + round_even(ov / greatest(n, 1), 0)::BIGINT AS total_tokens, row_number() OVER (PARTITION BY pmid ORDER BY o_orderdate DESC, session) AS place FROM r""")
def cost_history(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("pmid"), k.alias("session"), F.floor("o_totalprice").alias("overhead_total"), F.nullif(k % 4, F.lit(0)).alias("n_articles"), (F.col("o_custkey") * 10).alias("direct_tokens"), F.col("o_orderdate").alias("computed_at"))
    return metering.history(rows).select("pmid", "session", "overhead_share", "total_tokens", F.col("place").cast("long").alias("place"))


@query(f"WITH {METER} SELECT session, article, round_even(overhead_inp * (direct_inp / greatest(sum(direct_inp) OVER (PARTITION BY session), 1)), 0)::BIGINT AS share_inp FROM tot")
def token_alloc_by_work(spark, d):
    turns, keys = attributed(spark, d)
    return metering.allocate(metering.direct_and_shared(turns, keys), by_direct=True).select("session", "article", "share_inp")


@query("""WITH k AS (SELECT conv_id AS session, turn, text, length(text) AS n, ' ' || split_part(text, ' ', 1) || ' ' AS own FROM conversations), a AS (SELECT session, min(turn) AS t FROM k GROUP BY session),
w AS (SELECT a.session, lower(split_part(text, ' ', 1)) AS key FROM a JOIN conversations c ON a.session = c.conv_id AND a.t = c.turn WHERE split_part(text, ' ', 1) <> '')
SELECT k.session, k.turn, CASE WHEN w.key IS NOT NULL AND contains(lower(k.text), w.key) THEN 1 ELSE 0 END AS n_owners FROM k LEFT JOIN w ON k.session = w.session""")
def token_ownership(spark, d):
    """Turns that name their session's article: the first word of its first turn."""
    c = table(spark, d, "conversations")
    turns = c.select(F.col("conv_id").alias("session"), "turn", F.lower("text").alias("blob"))
    keys = c.groupBy(F.col("conv_id").alias("session")).agg(F.min_by(F.substring_index("text", " ", 1), "turn").alias("key")).withColumn("article", F.lit("a"))
    return metering.attribute(turns, keys).select("session", "turn", "n_owners")


@query("""WITH r AS (SELECT l_orderkey AS paper, CASE WHEN l_orderkey % 3 = 0 THEN 'control' ELSE 'curated' END AS g, l_orderkey * 10 AS t, CASE WHEN l_orderkey % 2 = 0 THEN 'm' || (l_orderkey % 4) END AS m FROM lineitem), p AS (SELECT paper, g, max(t) AS t, max(m) AS m FROM r GROUP BY paper, g)
SELECT g AS "group", count(*) AS n_papers, sum(t)::BIGINT AS tokens, string_agg(DISTINCT m, ',' ORDER BY m) AS models FROM p GROUP BY g""")
def sheet_totals(spark, d):
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select(k.alias("paper"), F.when(k % 3 == 0, "control").otherwise("curated").alias("group"), (k * 10).alias("tokens"), F.when(k % 2 == 0, F.concat(F.lit("m"), (k % 4).cast("string"))).alias("model"))
    return scoring.sheet_totals(rows).withColumn("models", F.array_join("models", ","))


@query("""WITH s AS (SELECT c_custkey AS paper, 'a' AS item, CASE WHEN c_nationkey % 2 = 0 THEN 'Correct' ELSE 'N/A' END AS rating FROM customer UNION ALL SELECT c_custkey, 'b', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Incorrect' END FROM customer UNION ALL SELECT c_custkey, 'c', CASE WHEN c_custkey % 2 = 0 THEN 'Needs improvement' ELSE '' END FROM customer)
SELECT paper, item, rating FROM s""")
def stacked_sheets(spark, d):
    """Sheets of different items stacked, then in long form; what one lacks is empty."""
    c, first = table(spark, d, "customer"), F.when(F.col("c_nationkey") % 2 == 0, "Correct").otherwise("Not applicable").alias("a")
    odd = c.where("c_custkey % 2 <> 0").select(F.col("c_custkey").cast("string").alias("paper"), first, F.lit("Incorrect").alias("b"))
    even = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("paper"), first, F.lit("Needs improvement").alias("c"))
    return scoring.long_scores(stack_scorecards([odd, even]), ["paper"]).withColumn("paper", F.col("paper").cast("long"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN '–' ELSE CAST(round_even(100 * (o_custkey % 129) / 128.0, 0)::INT AS VARCHAR) || '%' END AS share, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS n, CASE WHEN length(o_orderpriority) > 6 THEN substr(o_orderpriority, 1, 5) || '…' ELSE o_orderpriority END AS cut, CASE WHEN o_orderkey % 5 <> 0 THEN format('{:,}', o_orderkey * 997) ELSE '–' END AS shown FROM orders""")
def number_cells(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", text.percent(F.when(c % 7 != 0, (c % 129) / 128.0)).alias("share"), text.lenient_int(F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), c.cast("string")))).cast("long").alias("n"), text.truncated(F.col("o_orderpriority"), 6).alias("cut"), text.thousands(F.when(k % 5 != 0, k * 997)).alias("shown"))


@query(f"""WITH {EVENTS}, g AS (SELECT ontology, norm, count(*) AS seen, count(DISTINCT pmid) AS n, bool_or(filed IS NOT NULL) AS f FROM e WHERE value <= 30 GROUP BY ontology, norm)
SELECT ontology, norm, row_number() OVER (ORDER BY f, n DESC, seen DESC, norm, ontology) AS place FROM g QUALIFY place <= 20""")
def gap_heads(spark, d):
    """The twenty gaps that matter most: a top-k report."""
    return ledger.ranked(ledger.gap_rank(event_ledger(spark, d)), ledger.gap_order(), 20).select("ontology", "norm", F.col("place").cast("long").alias("place"))


@query(f"WITH {EVENTS}, s AS (SELECT ontology, 'T' || pmid AS t, count(DISTINCT phrase) AS n FROM e WHERE value > 30 GROUP BY ontology, pmid) SELECT ontology, t AS matched_term, row_number() OVER (ORDER BY n DESC, t, ontology) AS place FROM s QUALIFY place <= 20")
def synonym_heads(spark, d):
    return ledger.ranked(ledger.synonym_rank(event_ledger(spark, d)), ledger.synonym_order(), 20).select("ontology", "matched_term", F.col("place").cast("long").alias("place"))


@query("""WITH r AS (SELECT o_orderkey AS draft, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 3 ELSE 5 END AS rank, o_custkey % 9 AS flags FROM orders) SELECT draft, row_number() OVER (ORDER BY rank, flags DESC, draft) AS place FROM r QUALIFY place <= 25""")
def review_heads(spark, d):
    p = F.col("o_orderpriority")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft"), F.when(p == "1-URGENT", "needs_human_decision").when(p == "2-HIGH", "in_scope").otherwise("nonsense").alias("triage"), (F.col("o_custkey") % 9).alias("flags"))
    return ledger.ranked(rows, catalog.review_order(F.col("triage"), F.col("flags"), F.col("draft")), 25).select("draft", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT CASE l_linenumber WHEN 1 THEN 'other' WHEN 2 THEN 'needs_pmid' WHEN 3 THEN 'scope_question' WHEN 4 THEN 'zeta' WHEN 5 THEN 'alpha' ELSE 'needs_accession' END AS category, count(*) AS n FROM lineitem GROUP BY 1)
SELECT category, n, row_number() OVER (ORDER BY CASE category WHEN 'needs_pmid' THEN 1 WHEN 'needs_accession' THEN 2 WHEN 'scope_question' THEN 6 WHEN 'other' THEN 8 ELSE 9 END, category) AS place FROM f""")
def flag_order(spark, d):
    n = F.col("l_linenumber")
    category = F.when(n == 1, "other").when(n == 2, "needs_pmid").when(n == 3, "scope_question").when(n == 4, "zeta").when(n == 5, "alpha").otherwise("needs_accession")
    counted = table(spark, d, "lineitem").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return ledger.ranked(counted, catalog.flag_place(F.col("category")), 100).select("category", "n", F.col("place").cast("long").alias("place"))


@query("""WITH t AS (SELECT p_brand AS topic, p_partkey AS name FROM part UNION SELECT p_type, p_partkey FROM part) SELECT topic, name, row_number() OVER (PARTITION BY topic ORDER BY name) AS place FROM t""")
def topic_index(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.array("p_brand", "p_type", "p_brand").alias("topics"))
    return catalog.by_topic(rows).withColumn("place", F.col("place").cast("long"))


@query(r"""WITH f AS (SELECT c_custkey AS name, 'format-version: 1.2' || chr(10) || (CASE WHEN c_custkey % 2 = 0 THEN 'data-version: r/' || c_nationkey || chr(10) ELSE '' END) || chr(10) || '[Term]' || chr(10) || 'id: X:1' || chr(10) || 'name: ' || c_name || chr(10) || 'id: Y:2' || chr(10) || (CASE WHEN c_nationkey > 5 THEN 'id: X:3' ELSE '' END) AS text, c_custkey, c_nationkey FROM customer)
SELECT name, CASE WHEN c_custkey % 2 = 0 THEN 'r/' || c_nationkey END AS release, CASE WHEN c_nationkey > 5 THEN 2 ELSE 1 END AS n_terms, substr(sha256(text), 1, 12) AS digest FROM f""")
def snapshot_summaries(spark, d):
    nation = F.col("c_nationkey").cast("string")
    release = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("data-version: r/"), nation, F.lit("\n"))).otherwise("")
    said = F.concat(F.lit("format-version: 1.2\n"), release, F.lit("\n[Term]\nid: X:1\nname: "), "c_name", F.lit("\nid: Y:2\n"), F.when(F.col("c_nationkey") > 5, "id: X:3").otherwise(""))
    return catalog.snapshot_summary(table(spark, d, "customer").select(F.col("c_custkey").alias("name"), said.alias("text")), "X")


@query("""WITH r AS (SELECT c_custkey, [CASE WHEN c_custkey % 11 = 0 THEN 'name' END, CASE WHEN c_custkey % 3 = 0 THEN 'status' END, CASE WHEN c_nationkey < 3 THEN 'topics' END, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY') THEN 'type' END] AS e FROM customer)
SELECT c_custkey, array_to_string(list_filter(e, lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def record_contract(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 11 == 0, " ").otherwise("n").alias("name"), F.when(k % 3 == 0, "new").when(k % 3 == 1, "validated").otherwise("draft").alias("status"), F.when(F.col("c_nationkey") >= 3, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("topics"), F.col("c_mktsegment").alias("type"))
    return rows.select("c_custkey", F.array_join(catalog.record_errors(("HOUSEHOLD", "MACHINERY")), ",").alias("errors"))


@query(f"WITH {MATCHES}, by_phrase AS (SELECT phrase FROM kept GROUP BY phrase) SELECT count(*) AS n_phrases, count(b.phrase) AS n_matched FROM phrases p LEFT JOIN by_phrase b ON p.phrase = b.phrase")
def match_rate(spark, d):
    status = QUERIES["term_match_status"](spark, d)
    return status.agg(F.count(F.lit(1)).alias("n_phrases"), F.count_if(F.col("status") != "no_match").alias("n_matched"))


# ---- streams -------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS session, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS tokens FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def stream_tokens_session(spark, d):
    """Sessions that ended before the watermark."""
    turns = event_stream(spark, d).select("ts", F.col("user_id").alias("session"), F.col("value").alias("tokens"))
    out = jobs.run_to_table(jobs.tokens_by_session(turns), "append")
    return out.select("session", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("tokens", 4).alias("tokens"))


@query("""WITH h AS (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start, user_id AS session, value FROM events)
SELECT start, session, count(*) AS n, round(sum(value), 4) AS tokens FROM h WHERE start + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2""")
def stream_tokens_sliding(spark, d):
    turns = event_stream(spark, d).select("ts", F.col("user_id").alias("session"), F.col("value").alias("tokens"))
    out = jobs.run_to_table(jobs.tokens_by_window(turns, "1 day", "12 hours"), "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "session", "n", F.round("tokens", 4).alias("tokens"))
