"""The operators over whole driver tables, each with the same in DuckDB SQL.

A table plays the part that its columns allow: parts are vocabulary terms,
orders drafts and articles, lineitems references, sessions and ratings, events
the gap ledger, conversations session transcripts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.functions import identifiers, text
from scriptorium.functions.shares import dealt, shares_of
from scriptorium.operators import catalog, documents, drafts, ledger, matching, metering, scoring, tracking, validation
from scriptorium.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- terms ---------------------------------------------------------------


def part_terms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    subsets = F.when(F.col("p_type") == "PROMO", F.array(F.lit("qc_do_not_annotate"))).when(F.col("p_type") == "SMALL", F.array(F.lit("qc_extension_only"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_type", "p_brand")).alias("synonyms"), (F.col("p_size") > 45).alias("obsolete"), subsets.alias("subsets"))


def part_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    made = p.select(F.concat_ws(" ", F.lower("p_type"), F.substring_index("p_name", " ", -1)).alias("phrase")).unionByName(p.select(F.col("p_name").alias("phrase"))).distinct()
    made = made.unionByName(spark.range(1).select(F.lit("zzz nothing here").alias("phrase")))
    return made.select(F.col("phrase").alias("phrase_id"), "phrase")


TOKENS = r"""
texts AS (SELECT p_partkey AS term_id, p_name AS txt FROM part UNION SELECT p_partkey, p_type || ' ' || p_brand FROM part),
tok AS (SELECT DISTINCT term_id, txt, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS token FROM texts),
idf AS (SELECT token, count(DISTINCT term_id) AS df, ln((SELECT count(*) FROM part) / count(DISTINCT term_id)) AS w FROM tok GROUP BY token)"""

MATCHES = TOKENS + r""",
phrases AS (
  SELECT lower(p_type) || ' ' || regexp_extract(p_name, '[^ ]*$', 0) AS phrase FROM part UNION SELECT p_name FROM part UNION SELECT 'zzz nothing here'),
pt AS (SELECT DISTINCT phrase, unnest(regexp_extract_all(lower(phrase), '[a-z0-9]+')) AS token FROM phrases),
pw AS (SELECT pt.phrase, pt.token, coalesce(idf.w, (SELECT max(w) FROM idf)) AS w FROM pt LEFT JOIN idf ON pt.token = idf.token),
mass AS (SELECT phrase, sum(w) AS mass FROM pw GROUP BY phrase HAVING sum(w) > 0),
pair AS (SELECT pw.phrase, tok.term_id, tok.txt, sum(pw.w) AS shared, count(*) AS n FROM pw JOIN tok ON pw.token = tok.token GROUP BY pw.phrase, tok.term_id, tok.txt),
scored AS (
  SELECT pair.phrase, pair.term_id, lower(txt) = lower(pair.phrase) AS exact,
         CASE WHEN lower(txt) = lower(pair.phrase) THEN 100.0
              WHEN contains(lower(txt), lower(pair.phrase)) THEN greatest(60.0 * shared / mass, 60.0 + n) ELSE 60.0 * shared / mass END AS score
  FROM pair JOIN mass ON pair.phrase = mass.phrase),
best AS (SELECT phrase, term_id, bool_or(exact) AS exact, max(score) AS score FROM scored GROUP BY phrase, term_id HAVING max(score) >= 20.0 - 1e-9),
found AS (
  SELECT best.*, p_name AS name, CASE WHEN p_size > 45 OR p_type = 'PROMO' THEN 'withheld' ELSE 'offered' END AS disposition
  FROM best JOIN part ON p_partkey = term_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY phrase, disposition ORDER BY exact DESC, round(score, 9) DESC, term_id) AS rank FROM found),
kept AS (SELECT * FROM ranked WHERE rank <= 5)"""


@query(f"WITH {TOKENS} SELECT token, df, round(w, 6) AS idf FROM idf")
def term_idf(spark, d):
    return matching.idf(matching.term_texts(part_terms(spark, d))).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {MATCHES} SELECT phrase AS phrase_id, term_id, exact, round(score, 6) AS score, disposition, rank FROM kept")
def term_match_topk(spark, d):
    found = matching.match_terms(part_phrases(spark, d), part_terms(spark, d))
    return found.select("phrase_id", "term_id", "exact", F.round("score", 6).alias("score"), "disposition", "rank")


@query(f"""WITH {MATCHES},
by_phrase AS (
  SELECT phrase, sum(CASE WHEN disposition = 'offered' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN disposition = 'withheld' THEN 1 ELSE 0 END) AS w,
         max(CASE WHEN exact AND disposition = 'offered' THEN 1 ELSE 0 END) AS e FROM kept GROUP BY phrase)
SELECT p.phrase AS phrase, CAST(coalesce(o, 0) AS BIGINT) AS n_offered, CAST(coalesce(w, 0) AS BIGINT) AS n_withheld,
       CASE WHEN e = 1 THEN 'exact' WHEN o > 0 THEN 'candidates' WHEN w > 0 THEN 'withheld_only' ELSE 'no_match' END AS status
FROM phrases p LEFT JOIN by_phrase b ON p.phrase = b.phrase""")
def term_match_status(spark, d):
    phrases = part_phrases(spark, d)
    return matching.match_status(phrases, matching.match_terms(phrases, part_terms(spark, d))).select("phrase", "n_offered", "n_withheld", "status")


@query(f"WITH {MATCHES} SELECT phrase AS phrase_id, term_id, name, rank FROM kept WHERE disposition = 'withheld'")
def term_withheld(spark, d):
    """What matches and may not be offered, ranked apart."""
    found = matching.match_terms(part_phrases(spark, d), part_terms(spark, d))
    return found.where("disposition = 'withheld'").select("phrase_id", "term_id", "name", "rank")


@query(f"""WITH {MATCHES}, r AS (SELECT phrase, sum(CASE WHEN name LIKE '% ring' THEN 0 ELSE 1 END)::BIGINT AS u, sum(CASE WHEN name LIKE '% ring' THEN 1 ELSE 0 END)::BIGINT AS m FROM kept GROUP BY phrase)
SELECT p.phrase AS phrase_id, coalesce(u, 0) AS n_usable, coalesce(m, 0) AS n_mismatched, coalesce(u = 0 AND m > 0, false) AS all_mismatched FROM phrases p LEFT JOIN r ON p.phrase = r.phrase""")
def context_review(spark, d):
    """Rings are taken for structures in a host."""
    phrases = part_phrases(spark, d)
    found = matching.match_terms(phrases, part_terms(spark, d)).withColumn("name", F.regexp_replace("name", " ring$", " in host ring"))
    return matching.context_review(phrases, found, "free-living")


PASSAGES = r"""
WITH lines AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS line FROM documents),
b AS (SELECT item_id, trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS line FROM benchmark)
SELECT l.doc_id, b.item_id, count(*) AS n_lines FROM lines l JOIN b ON l.line = b.line WHERE length(l.line) >= 30 GROUP BY l.doc_id, b.item_id"""


@query(PASSAGES)
def doc_passage_match(spark, d):
    """Sentences of documents that benchmark passages have: an equi-join on the sentence."""
    lines = F.explode(F.filter(F.transform(F.split("text", "[.\n]"), lambda x: F.trim(x)), lambda x: F.length(x) >= 30))
    docs = table(spark, d, "documents").select("doc_id", lines.alias("line"))
    items = table(spark, d, "benchmark").select("item_id", lines.alias("line"))
    return docs.join(items, "line").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_lines"))


# ---- identifiers ---------------------------------------------------------

ID_SQL = r"""ids AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'GO' WHEN 1 THEN 'MOD' WHEN 2 THEN 'bto' ELSE 'XX' END AS p,
         lpad(CAST(l_partkey + (CASE WHEN l_returnflag = 'R' THEN 100000 ELSE 0 END) AS VARCHAR), CASE WHEN l_linenumber % 4 = 1 THEN 5 WHEN l_linenumber = 6 THEN 8 ELSE 7 END, '0') AS local FROM lineitem)"""


def line_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    prefix = F.when(n == 0, "GO").when(n == 1, "MOD").when(n == 2, "bto").otherwise("XX")
    width = F.when(n == 1, 5).when(F.col("l_linenumber") == 6, 8).otherwise(7)
    number = (F.col("l_partkey") + F.when(F.col("l_returnflag") == "R", 100_000).otherwise(0)).cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(prefix, F.lit(":"), F.call_function("lpad", number, width, F.lit("0"))).alias("input_id"))


def part_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    number = F.lpad(p.p_partkey.cast("string"), 7, "0")
    return p.select(F.explode(F.array(F.concat(F.lit("GO:"), number), F.concat(F.lit("BTO:"), number))).alias("term_id"), F.col("p_name").alias("label"), (p.p_size > 45).alias("obsolete"))


@query(f"WITH {ID_SQL} SELECT l_orderkey AS doc, count(DISTINCT CASE WHEN p <> 'XX' THEN upper(p) || ':' || local END) AS n_ids FROM ids GROUP BY l_orderkey")
def id_extract(spark, d):
    """Identifiers within texts that are put together of each order's lines."""
    texts = line_ids(spark, d).groupBy("l_orderkey").agg(F.concat_ws(", see ", F.collect_list("input_id")).alias("text"))
    return texts.select(F.col("l_orderkey").alias("doc"), F.size(F.array_distinct(F.transform(identifiers.extract_ids(F.col("text")), F.upper))).cast("long").alias("n_ids"))


VALIDATED = ID_SQL + r""",
st AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN p = 'XX' THEN NULL ELSE upper(p) END AS prefix, CASE WHEN p = 'XX' THEN false WHEN p = 'MOD' THEN length(local) = 5 ELSE length(local) = 7 END AS format_valid,
         CASE WHEN p = 'XX' THEN 'unknown_prefix' WHEN length(local) <> (CASE WHEN p = 'MOD' THEN 5 ELSE 7 END) THEN 'format_invalid'
              WHEN p = 'MOD' THEN 'format_checked_only' WHEN p_partkey IS NULL THEN 'not_found' WHEN p_size > 45 THEN 'obsolete' ELSE 'exists' END AS existence,
         CASE WHEN p IN ('GO', 'bto') AND length(local) = 7 THEN p_name END AS label
  FROM ids LEFT JOIN part ON CAST(local AS BIGINT) = p_partkey)"""


@query(f"WITH {VALIDATED} SELECT l_orderkey, l_linenumber, prefix, format_valid, existence, existence IN ('exists', 'format_checked_only') AS ok, label FROM st")
def id_validate(spark, d):
    return validation.validate_ids(line_ids(spark, d), part_index(spark, d), ("GO", "BTO")).select("l_orderkey", "l_linenumber", "prefix", "format_valid", "existence", "ok", "label")


@query(f"""WITH {ID_SQL}, st AS (SELECT CASE WHEN p = 'XX' THEN 'unknown_prefix' WHEN length(local) <> (CASE WHEN p = 'MOD' THEN 5 ELSE 7 END) THEN 'format_invalid' WHEN p = 'MOD' THEN 'format_checked_only' WHEN p = 'GO' THEN 'not_checked' ELSE 'error' END AS existence FROM ids)
SELECT existence, existence = 'format_checked_only' AS ok, count(*) AS n FROM st GROUP BY existence""")
def id_unchecked(spark, d):
    """One index not asked for, the other one unreadable: neither says that an id is absent."""
    index = part_index(spark, d).where("term_id not like 'BTO:%'")
    found = validation.validate_ids(line_ids(spark, d), index, ("GO", "BTO"), skipped=("GO",), broken=("BTO",))
    return found.groupBy("existence", "ok").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VALIDATED} SELECT round(avg(CASE WHEN existence IN ('exists', 'format_checked_only') THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS n FROM st")
def id_validate_rate(spark, d):
    v = validation.validate_ids(line_ids(spark, d), part_index(spark, d), ("GO", "BTO"))
    return v.agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("pass_rate"), F.count(F.lit(1)).alias("n"))


OVERLAP = r"""
WITH p AS (SELECT DISTINCT l_orderkey AS paper, l_linestatus AS ns, l_partkey AS id FROM lineitem WHERE l_linenumber <= 3),
g AS (SELECT DISTINCT l_orderkey AS paper, l_linestatus AS ns, l_partkey AS id FROM lineitem WHERE l_returnflag <> 'R'),
f AS (SELECT coalesce(p.paper, g.paper) AS paper, coalesce(p.ns, g.ns) AS ns, p.id AS pid, g.id AS gid FROM p FULL JOIN g ON p.paper = g.paper AND p.ns = g.ns AND p.id = g.id),
c AS (SELECT {keys}, sum(CASE WHEN pid IS NOT NULL AND gid IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS tp, count(pid) AS np, count(gid) AS ng FROM f GROUP BY {keys}),
r AS (SELECT *, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS pr, CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS re FROM c)
SELECT {keys}, tp, np AS n_pred, ng AS n_gold, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM r"""


def _overlap(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linestatus").alias("ns"), F.col("l_partkey").alias("id"), "l_linenumber", "l_returnflag")
    both = scoring.overlap(rows.where("l_linenumber <= 3"), rows.where("l_returnflag <> 'R'"), ["paper", "ns"], "id", shares_of(rows))
    out = scoring.overlap_scores(both, keys, "id")
    return out.select(*keys, "tp", "n_pred", "n_gold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(OVERLAP.format(keys="paper"))
def gold_overlap(spark, d):
    return _overlap(spark, d, ["paper"])


@query(OVERLAP.format(keys="paper, ns"))
def gold_overlap_by_ns(spark, d):
    return _overlap(spark, d, ["paper", "ns"])


@query("""WITH q AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey + 1000000 FROM customer), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT CAST(k AS VARCHAR) AS pmid, coalesce(n, 0) AS n_records, CASE WHEN n > 0 THEN 'curated' ELSE 'not_curated' END AS status FROM q LEFT JOIN n ON k = o_custkey""")
def curated_lookup(spark, d):
    c = table(spark, d, "customer")
    asked = c.select(F.concat(F.lit("PMID: "), F.col("c_custkey").cast("string")).alias("pmid")).unionByName(c.select((F.col("c_custkey") + 1_000_000).cast("string").alias("pmid")))
    return validation.curated_lookup(asked, table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("pmid"))).select("pmid", "n_records", "status")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)
SELECT o_custkey AS pmid, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END)::BIGINT AS n_listed, sum(CASE WHEN rank > 5 THEN 1 ELSE 0 END)::BIGINT AS n_more, count(DISTINCT CASE WHEN rank > 5 THEN o_orderpriority END) AS more_kinds FROM r GROUP BY o_custkey""")
def curated_topn(spark, d):
    first, rest = validation.release_listing(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")])
    a = first.groupBy(F.col("o_custkey").alias("pmid")).agg(F.count(F.lit(1)).alias("n_listed"))
    b = rest.groupBy(F.col("o_custkey").alias("pmid")).agg(F.count(F.lit(1)).alias("n_more"), F.countDistinct("o_orderpriority").alias("more_kinds"))
    return a.join(b, "pmid", "left").fillna(0)


@query("SELECT count(*) AS n_records, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS n_pmids, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS n_non_pubmed FROM orders")
def release_stats(spark, d):
    pmid = F.when(F.col("o_orderstatus") == "P", "ISBN 1").otherwise(F.col("o_custkey").cast("string"))
    return validation.release_stats(table(spark, d, "orders"), pmid)


@query("""WITH q AS (SELECT DISTINCT p_name AS name, p_size % 7 AS taxon FROM part),
p AS (SELECT p_partkey AS acc, p_name AS name, p_size AS taxon, p_retailprice > 950 AS reviewed FROM part),
s AS (SELECT q.name, q.taxon, acc, reviewed, count(*) OVER (PARTITION BY q.name, q.taxon) AS n, row_number() OVER (PARTITION BY q.name, q.taxon ORDER BY reviewed DESC, acc) AS r FROM q JOIN p ON p.name = q.name AND p.taxon = q.taxon),
l AS (SELECT name, acc, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY reviewed DESC, acc) AS r FROM p)
SELECT q.name, q.taxon, coalesce(s.n, l.n) AS n, coalesce(s.acc, l.acc) AS accession, s.n IS NULL AS organism_filter_relaxed, CASE WHEN coalesce(s.n, l.n) = 1 THEN 'found' ELSE 'ambiguous' END AS status
FROM q LEFT JOIN s ON q.name = s.name AND q.taxon = s.taxon AND s.r = 1 LEFT JOIN l ON q.name = l.name AND l.r = 1""")
def protein_resolve(spark, d):
    p = table(spark, d, "part")
    proteins = p.select(F.col("p_partkey").alias("accession"), F.col("p_name").alias("name"), F.col("p_size").alias("taxon"), (F.col("p_retailprice") > 950).alias("reviewed"), F.col("p_partkey").alias("position"))
    asked = p.select(F.col("p_name").alias("name"), (F.col("p_size") % 7).alias("taxon")).distinct().withColumns({"query_id": F.concat_ws("|", "name", "taxon"), "kind": F.lit("locus")})
    return validation.resolve_proteins(asked, proteins).select("name", "taxon", "n", "accession", "organism_filter_relaxed", "status")


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pmid' WHEN page_id % 4 = 1 THEN 'pmcid' WHEN page_id % 4 = 2 THEN 'doi' ELSE 'error' END AS kind,
CASE WHEN page_id % 4 = 1 AND page_id % 3 = 0 THEN 'jats' WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'abstract' END AS route FROM pages""")
def pub_route(spark, d):
    n = F.col("page_id")
    given = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.concat(F.lit("pmc"), n.cast("string"))).when(n % 4 == 2, F.concat(F.lit("10.1234/x"), n.cast("string"))).otherwise("unknown")
    kind = validation.identifier_kind(given)
    route = validation.route_for(n % 3 == 0, F.when(kind == "pmcid", given), n % 5 == 0)
    return table(spark, d, "pages").select("page_id", kind.alias("kind"), route.alias("route"))


# ---- ledger --------------------------------------------------------------


def event_ledger(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    outcome = F.when(F.col("value") > 30, "synonym").otherwise("gap")
    phrase = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Phrase  "), k)).otherwise(F.concat(F.lit(" phrase "), k))
    events = table(spark, d, "events") if events is None else events
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("ontology"), phrase.alias("phrase"), outcome.alias("outcome"), F.col("user_id").cast("string").alias("pmid"),
        F.lit(None).cast("string").alias("context"), F.when(outcome == "synonym", F.concat(F.lit("T"), F.col("user_id").cast("string"))).alias("matched_term"),
        F.when((F.col("value") > 20) & (F.col("value") <= 30), F.col("event_id").cast("string")).alias("filed"),
    )


EVENTS = r"""e AS (SELECT event_id AS seq, event_type AS ontology, 'phrase ' || json_extract_string(props, '$.k') AS norm,
  CASE WHEN event_id % 2 = 0 THEN 'Phrase  ' || json_extract_string(props, '$.k') ELSE ' phrase ' || json_extract_string(props, '$.k') END AS phrase,
  CAST(user_id AS VARCHAR) AS pmid, CASE WHEN value > 20 THEN CAST(event_id AS VARCHAR) END AS filed, value FROM events)"""


@query(f"""WITH {EVENTS} SELECT ontology, norm, count(*) AS seen, count(DISTINCT pmid) AS n_papers, count(DISTINCT phrase) AS n_variants, arg_max(phrase, seq) AS phrase,
max(CASE WHEN filed IS NOT NULL THEN seq END) AS filed FROM e WHERE value <= 30 GROUP BY ontology, norm""")
def gap_rank(spark, d):
    ranked = ledger.gap_rank(event_ledger(spark, d))
    return ranked.select("ontology", "norm", "seen", F.size("papers").cast("long").alias("n_papers"), F.size("variants").cast("long").alias("n_variants"), "phrase", F.col("filed").cast("long").alias("filed"))


@query(f"WITH {EVENTS} SELECT ontology, 'T' || pmid AS matched_term, count(DISTINCT phrase) AS n_missed, count(DISTINCT pmid) AS n_papers FROM e WHERE value > 30 GROUP BY ontology, pmid")
def synonym_rank(spark, d):
    return ledger.synonym_rank(event_ledger(spark, d))


@query("SELECT CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown ontology' END AS rejected, count(*) AS n FROM events GROUP BY 1")
def ledger_checks(spark, d):
    return ledger.checked_events(event_ledger(spark, d), ("CLICK", "VIEW")).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


# ---- streams ---


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH {EVENTS}, f AS (SELECT ontology, norm, pmid, min(seq) AS f FROM e WHERE value <= 30 GROUP BY ALL),
p AS (SELECT ontology, norm, string_agg(pmid, ',' ORDER BY f, pmid) AS papers FROM f GROUP BY ontology, norm)
SELECT e.ontology, e.norm, count(*) AS seen, count(DISTINCT pmid) AS n_papers, count(DISTINCT phrase) AS n_variants, arg_max(phrase, seq) AS phrase,
max(CASE WHEN filed IS NOT NULL THEN seq END) AS filed, 0 AS n_contexts, any_value(papers) AS papers FROM e JOIN p ON e.ontology = p.ontology AND e.norm = p.norm WHERE value <= 30 GROUP BY e.ontology, e.norm""")
def stream_gap_rank(spark, d):
    """The ledger as a stream, ranked as ``gap_rank`` does."""
    found = jobs.run_ranking(event_ledger(spark, d, event_stream(spark, d))).ranking()
    return found.select("ontology", "norm", "seen", "n_papers", "n_variants", "phrase", F.col("filed").cast("long").alias("filed"), "n_contexts", F.array_join("papers", ",").alias("papers"))


@query(f"""WITH {EVENTS}, g AS (SELECT ontology, norm, count(*) AS seen, count(DISTINCT pmid) AS n_papers, max(CASE WHEN filed IS NOT NULL THEN seq END) AS filed FROM e WHERE value <= 30 GROUP BY ontology, norm)
SELECT ontology, norm, seen, n_papers FROM g ORDER BY filed IS NOT NULL, n_papers DESC, seen DESC, norm, ontology LIMIT 15""")
def stream_gap_heads(spark, d):
    """The head of that ranking, as the stream keeps it."""
    return jobs.run_ranking(event_ledger(spark, d, event_stream(spark, d)), top=15).top().select("ontology", "norm", "seen", "n_papers")


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, user_id AS session, count(*) AS n, round(sum(value), 4) AS tokens FROM events GROUP BY 1, 2)
SELECT start, session, n, tokens FROM w WHERE start + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def stream_tokens_tumbling(spark, d):
    turns = event_stream(spark, d).select("ts", F.col("user_id").alias("session"), F.col("value").alias("tokens"))
    out = jobs.run_to_table(jobs.tokens_by_window(turns, "1 day"), "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "session", "n", F.round("tokens", 4).alias("tokens"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    rows = event_stream(spark, d).select("user_id", "event_id")
    return jobs.run_upserts(rows, ["user_id"], "event_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_new_only(spark, d):
    rows = event_stream(spark, d).select("user_id", "event_id")
    with jobs.rocksdb(spark):
        return jobs.run_to_table(jobs.first_seen(rows, "user_id", "event_id"), "append")


@query("SELECT event_id, CASE WHEN e.event_id % 3 = 0 THEN 'unknown_prefix' WHEN p_partkey IS NULL THEN 'not_found' WHEN p_size > 45 THEN 'obsolete' ELSE 'exists' END AS existence, CASE WHEN e.event_id % 3 <> 0 THEN p_name END AS label FROM events e LEFT JOIN part ON e.event_id = p_partkey")
def stream_validate(spark, d):
    ids = event_stream(spark, d).select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "ZZ:").otherwise("go:"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("input_id"))
    out = jobs.run_to_table(jobs.validated(ids, part_index(spark, d), ("GO", "BTO")), "append")
    return out.select("event_id", "existence", "label")


# ---- scores --------------------------------------------------------------

RATED = r"""r AS (SELECT l_orderkey AS paper, CASE WHEN l_orderkey % 3 = 0 THEN 'control' ELSE 'curated' END AS grp, l_linenumber AS item,
  CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END AS pts, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 7 END AS curatable, l_orderkey % 8 AS captured FROM lineitem),
ps AS (SELECT paper, grp, avg(pts) AS accuracy, max(captured) / nullif(max(curatable), 0) AS completeness FROM r GROUP BY paper, grp)"""


def ratings(spark: SparkSession, d: str) -> DataFrame:
    flag, k = F.col("l_returnflag"), F.col("l_orderkey")
    rating = F.when(flag == "A", "Correct").when(flag == "N", "Needs improvement").otherwise("Incorrect")
    group = F.when(k % 3 == 0, "control").otherwise("curated")
    return table(spark, d, "lineitem").select(k.alias("paper"), group.alias("group"), F.col("l_linenumber").cast("string").alias("item"), rating.alias("rating"), F.when(k % 5 == 0, 0).otherwise(7).alias("curatable"), (k % 8).alias("captured"))


@query(f"WITH {RATED} SELECT paper, grp AS \"group\", round(accuracy, 6) AS accuracy, round(completeness, 6) AS completeness FROM ps")
def paper_scores(spark, d):
    return scoring.paper_scores(ratings(spark, d)).select("paper", "group", F.round("accuracy", 6).alias("accuracy"), F.round("completeness", 6).alias("completeness"))


@query(f"""WITH {RATED} SELECT CAST(item AS VARCHAR) AS item, CAST(NULL AS VARCHAR) AS "group", round(avg(pts), 6) AS accuracy, count(*) AS n_rated FROM r GROUP BY item
UNION ALL SELECT NULL, grp, round(avg(pts), 6), count(*) FROM r GROUP BY grp UNION ALL SELECT NULL, NULL, round(avg(pts), 6), count(*) FROM r""")
def item_accuracy(spark, d):
    return scoring.item_accuracy(ratings(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(f'WITH {RATED} SELECT grp AS "group", count(*) AS n_papers, round(avg(accuracy), 6) AS accuracy, round(avg(completeness), 6) AS completeness FROM ps GROUP BY grp')
def group_scores(spark, d):
    out = scoring.group_scores(scoring.paper_scores(ratings(spark, d)))
    return out.select("group", "n_papers", F.round("accuracy", 6).alias("accuracy"), F.round("completeness", 6).alias("completeness"))


# ---- drafts --------------------------------------------------------------

STATES = r"""
gene AS (SELECT s_suppkey AS g, CASE WHEN s_acctbal < 0 THEN 'held' ELSE 'ok' END AS st FROM supplier),
link AS (SELECT l_orderkey AS o, l_suppkey * 1000000 + l_partkey AS al, l_suppkey + (CASE WHEN l_partkey % 50 = 0 THEN 1000000 ELSE 0 END) AS g FROM lineitem),
allele AS (SELECT o, al, CASE WHEN max(CASE WHEN st IS NULL THEN 1 ELSE 0 END) = 1 THEN 'undefined' WHEN max(CASE WHEN st = 'held' THEN 1 ELSE 0 END) = 1 THEN 'held' ELSE 'ok' END AS st
  FROM link LEFT JOIN gene ON link.g = gene.g GROUP BY o, al),
genotype AS (SELECT o, CASE WHEN max(CASE WHEN st <> 'ok' THEN 1 ELSE 0 END) = 1 THEN 'held' ELSE 'ok' END AS st FROM allele GROUP BY o)"""


def draft_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Alleles and genotypes of each order, a draft, with their problems."""
    line = table(spark, d, "lineitem")
    supplier = table(spark, d, "supplier")
    named = line.select(F.col("l_orderkey").alias("draft"), (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("name"), (F.col("l_suppkey") + F.when(F.col("l_partkey") % 50 == 0, 1_000_000).otherwise(0)).alias("parent"))
    accession = F.when(F.col("s_acctbal") < 0, F.lit(" ")).otherwise("P00001")
    shares = shares_of(line)
    genes = dealt(named.select("draft", F.col("parent").alias("name")), shares, "draft", "name").distinct().join(supplier.select(F.col("s_suppkey").alias("name"), accession.alias("accession")), "name")
    alleles = drafts.child_state(named, drafts.gene_state(genes), shares)
    genotypes = drafts.child_state(named.select("draft", F.lit("g").alias("name"), F.col("name").alias("parent")), alleles, shares, ("draft",))
    return alleles, genotypes


@query(f"WITH {STATES} SELECT 'allele' AS level, st AS problem, count(*) AS n FROM allele GROUP BY st UNION ALL SELECT 'genotype', st, count(*) FROM genotype GROUP BY st")
def integrity_errors(spark, d):
    alleles, genotypes = draft_states(spark, d)
    every = alleles.select(F.lit("allele").alias("level"), "problem").unionByName(genotypes.select(F.lit("genotype").alias("level"), "problem"))
    return every.groupBy("level", F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


PARKED = STATES + r""",
a AS (SELECT o_orderkey AS draft, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'g' END AS feature, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE '' END AS hold,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'GO:1' END AS term, CASE WHEN o_orderkey % 4 = 0 THEN 'physical_interaction' WHEN o_orderkey % 4 = 1 THEN 'molecular_function' ELSE 'phenotype' END AS type,
  CASE WHEN o_custkey % 10 = 0 THEN 'not_found' END AS bad, CASE WHEN o_custkey % 3 = 0 THEN 'Inferred from x' ELSE '' END AS note FROM orders),
q AS (SELECT a.draft, CASE
  WHEN feature <> 'g' OR gt.o IS NULL THEN 'subject absent: ' || feature
  WHEN gt.st = 'held' THEN 'subject held' WHEN hold <> '' THEN 'on hold'
  WHEN term = '' AND type = 'physical_interaction' THEN '' WHEN term = '' THEN 'no term' WHEN bad IS NOT NULL THEN 'term not_found'
  WHEN type = 'molecular_function' AND note <> '' THEN 'not assayed' ELSE '' END AS reason
  FROM a LEFT JOIN genotype gt ON a.draft = gt.o)"""


def order_annotations(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("draft"), F.lit("genotype").alias("feature_type"), F.when(k % 11 == 0, "missing").otherwise("g").alias("feature"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").alias("hold"), F.lit(None).cast("string").alias("hold_reason"), F.when(F.col("o_orderstatus") != "P", "GO:1").alias("term_id"), F.lit("").alias("term_name"),
        F.when(k % 4 == 0, "physical_interaction").when(k % 4 == 1, "molecular_function").otherwise("phenotype").alias("type"), F.when(c % 3 == 0, "Inferred from x").alias("note"), F.when(c % 10 == 0, "not_found").alias("bad_term"),
    )


def order_queue(spark: SparkSession, d: str) -> DataFrame:
    _, genotypes = draft_states(spark, d)
    return drafts.queue_items(order_annotations(spark, d), genotypes.select("draft", F.lit("genotype").alias("feature_type"), "name", "problem"), shares=shares_of(table(spark, d, "orders")), by=("draft",))


@query(f"WITH {PARKED} SELECT draft, CASE WHEN reason = '' THEN 'enter' ELSE 'parked' END AS disposition, reason FROM q")
def park_items(spark, d):
    return order_queue(spark, d).select("draft", "disposition", "reason")


@query(f"WITH {PARKED} SELECT draft, sum(CASE WHEN reason = '' THEN 1 ELSE 0 END)::BIGINT AS n_enter, sum(CASE WHEN reason = '' THEN 0 ELSE 1 END)::BIGINT AS n_parked FROM q GROUP BY draft")
def queue_counts(spark, d):
    return drafts.queue_counts(order_queue(spark, d))  # which lies by drafts already


@query("""WITH v AS (SELECT p_brand AS type, l_returnflag || p_type AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT DISTINCT p_brand AS type, 'A' || p_type AS code FROM part WHERE p_size < 20)
SELECT v.type, value, count(*) AS n, CASE WHEN NOT v.type IN (SELECT type FROM c) THEN 'unchecked' WHEN bool_or(c.code IS NOT NULL) THEN 'ok' ELSE 'bad' END AS status
FROM v LEFT JOIN c ON v.type = c.type AND v.value = c.code GROUP BY v.type, value""")
def evidence_check(spark, d):
    part = table(spark, d, "part")
    values = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("type"), F.concat("l_returnflag", "p_type").alias("value"))
    return validation.check_codes(values, part.where("p_size < 20").select(F.col("p_brand").alias("type"), F.concat(F.lit("A"), "p_type").alias("code")))


@query("""SELECT o_orderkey AS draft, o_orderkey % 2 = 0 AS unused FROM orders WHERE o_orderkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def coverage_lint(spark, d):
    """Genotypes that nothing uses: references of even orders are left out."""
    used = table(spark, d, "lineitem").where("l_orderkey % 2 <> 0").select(F.col("l_orderkey").alias("draft"), F.lit("g").alias("name"))
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft"), F.lit("g").alias("name"))
    return drafts.unused_genotypes(every, used).select("draft", (F.col("draft") % 2 == 0).alias("unused"))


@query(r"SELECT c_custkey, lower(replace(replace(c_name, '#', ''), ' ', '')) || 'x' AS stem FROM customer")
def naming_lint(spark, d):
    named = F.concat("c_name", F.lit(" Δ"), F.lit("x(G1[a])"))
    return table(spark, d, "customer").select("c_custkey", text.allele_stem(named).alias("stem"))


@query("""SELECT p_brand AS relation, arg_min(p_type, p_partkey) AS range_id, count(DISTINCT p_name) AS n_display, count(DISTINCT p_size) AS n_types FROM part GROUP BY p_brand""")
def extension_rollup(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_no"), F.concat("p_brand", F.lit(" ")).alias("relation"), F.col("p_type").alias("range_id"), F.col("p_name").alias("display"), F.col("p_size").cast("string").alias("types"), F.lit("d").alias("domain"), F.lit("c").alias("cardinality"))
    return validation.relation_rollup(rows).select("relation", "range_id", F.size("display").cast("long").alias("n_display"), F.size("types").cast("long").alias("n_types"))


@query("""SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'free_text' WHEN 1 THEN 'gene_id' WHEN 2 THEN 'phipo_ext_term' WHEN 3 THEN 'bto_term' WHEN 4 THEN 'taxon_id' ELSE 'unknown' END AS kind FROM part""")
def extension_kinds(spark, d):
    n = F.col("p_size") % 6
    cell = F.when(n == 0, "Text").when(n == 1, "GeneID|ProteinID").when(n == 2, "PHIPO_EXT:0000001|%").when(n == 3, " BTO:1|BTO:2").when(n == 4, "HostTaxonID").otherwise("other")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), validation.range_kind(cell).alias("kind"))


# ---- metering ------------------------------------------------------------

METER = r"""
t AS (SELECT conv_id AS s, turn, role AS model, length(text) AS w, conv_id % 2 AS odd, turn % 4 AS q FROM conversations),
own AS (SELECT s, turn, model, w, CASE WHEN q = 1 THEN 'a' WHEN q = 2 THEN 'b' END AS owner FROM t),
dir AS (SELECT s, owner AS article, sum(w)::BIGINT AS direct, count(*) AS n FROM own WHERE owner IS NOT NULL GROUP BY s, owner),
sh AS (SELECT s, sum(CASE WHEN owner IS NULL THEN w ELSE 0 END)::BIGINT AS over, sum(CASE WHEN owner IS NULL THEN 1 ELSE 0 END)::BIGINT AS unmatched FROM own GROUP BY s),
tot AS (SELECT sh.s AS session, x.article, coalesce(dir.direct, 0) AS direct_inp, coalesce(dir.n, 0) AS n_matched, over AS overhead_inp, unmatched AS n_unmatched
  FROM sh CROSS JOIN (SELECT 'a' AS article UNION ALL SELECT 'b') x LEFT JOIN dir ON dir.s = sh.s AND dir.article = x.article)"""


def attributed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns that name article a, b, both or none, by their number."""
    said = F.when(F.col("turn") % 4 == 1, "about PMID-A now").when(F.col("turn") % 4 == 2, "pmid-b").when(F.col("turn") % 4 == 3, "pmid-a and pmid-b").otherwise("hello")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("role").alias("model"), F.lower(said).alias("blob"), F.length("text").cast("long").alias("inp"), *[F.lit(0).cast("long").alias(b) for b in metering.BUCKETS[1:]])
    keys = turns.select("session").distinct().select("session", F.explode(F.array(*[F.struct(F.lit(a).alias("article"), F.lit(f"PMID-{a}").alias("key")) for a in "ab"])).alias("k")).select("session", "k.*")
    return metering.attribute(turns, keys), keys


@query(f"WITH {METER} SELECT session, article, direct_inp, n_matched, overhead_inp, n_unmatched FROM tot")
def token_attribution(spark, d):
    turns, keys = attributed(spark, d)
    return metering.direct_and_shared(turns, keys).select("session", "article", "direct_inp", "n_matched", "overhead_inp", "n_unmatched")


@query(f"WITH {METER} SELECT session, article, round_even(overhead_inp * 0.5, 0)::BIGINT AS share_inp FROM tot")
def token_alloc(spark, d):
    turns, keys = attributed(spark, d)
    return metering.allocate(metering.direct_and_shared(turns, keys)).select("session", "article", "share_inp")


@query(f"""WITH {METER} SELECT CASE WHEN session % 2 = 0 THEN 'm1' ELSE 'other' END AS model, count(*) AS runs,
round(sum((round_even(overhead_inp * 0.5, 0) + direct_inp) * (CASE WHEN session % 2 = 0 THEN 3.0 ELSE 15.0 END) / 1e6), 6) AS cost FROM tot GROUP BY 1""")
def cost_by_model(spark, d):
    return metering.cost_by_model(model_costs(spark, d)).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {METER}, c AS (SELECT CASE WHEN session % 2 = 0 THEN 'm1' ELSE 'other' END AS model, article, (round_even(overhead_inp * 0.5, 0) + direct_inp) * (CASE WHEN session % 2 = 0 THEN 3.0 ELSE 15.0 END) / 1e6 AS cost FROM tot)
SELECT model, article, GROUPING(model, article)::INT AS level, count(*) AS runs, round(sum(cost), 6) AS cost FROM c GROUP BY ROLLUP (model, article)""")
def cost_rollup(spark, d):
    return metering.cost_rollup(model_costs(spark, d)).withColumn("cost", F.round("cost", 6))


def model_costs(spark: SparkSession, d: str) -> DataFrame:
    """A priced row for each session and article."""
    turns, keys = attributed(spark, d)
    rows = metering.allocate(metering.direct_and_shared(turns, keys)).withColumn("model", F.when(F.col("session") % 2 == 0, "m1").otherwise("other"))
    prices = spark.range(2).select(F.when(F.col("id") == 0, "m1").otherwise("default").alias("model"), F.when(F.col("id") == 0, 3.0).otherwise(15.0).alias("inp"), *[F.lit(0.0).alias(b) for b in metering.BUCKETS[1:]])
    return metering.priced(rows, prices)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey AS pmid, o_orderstatus AS model, o_orderkey AS run, round(o_totalprice, 6) AS cost FROM r WHERE n = 1""")
def token_history(spark, d):
    rows = table(spark, d, "orders")
    last = metering.latest_by_key(rows, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.select(F.col("o_custkey").alias("pmid"), F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("run"), F.round("o_totalprice", 6).alias("cost"))


# ---- tracking ------------------------------------------------------------

ARTICLE = """art AS (SELECT o_orderkey AS article_id, CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'curated' WHEN 3 THEN 'reviewed' ELSE 'published' END AS status,
  o_custkey % 20 AS curator, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS source_route, o_orderdate FROM orders)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, tracking.STATUSES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), status.alias("status"), (F.col("o_custkey") % 20).alias("curator"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("source_route"), "o_orderdate")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("curator"), F.col("l_shipdate").alias("session_date"), F.col("l_quantity").cast("long").alias("proteins"), F.col("l_linenumber").cast("long").alias("interactions"), F.col("l_tax").alias("hours"))


@query("""SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS curator, count(*) AS n_sessions, sum(CAST(l_quantity AS BIGINT))::BIGINT AS proteins, sum(l_linenumber)::BIGINT AS interactions, round(sum(l_tax), 6) AS hours
FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1998-01-01' - 700 GROUP BY 1, 2""")
def progress(spark, d):
    return tracking.progress(sessions(spark, d), dt.date(1998, 1, 1), 700).withColumn("hours", F.round("hours", 6))


@query(f"WITH {ARTICLE} SELECT status, count(*) AS n_articles, count(DISTINCT l_suppkey) AS n_proteins FROM art LEFT JOIN lineitem ON article_id = l_orderkey GROUP BY status")
def status_fanout(spark, d):
    return tracking.status_counts(articles(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("protein_id")))


@query(f"""WITH {ARTICLE}, s AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS p, sum(l_linenumber)::BIGINT AS i FROM lineitem GROUP BY l_orderkey)
SELECT article_id, status, coalesce(p, 0) AS proteins, coalesce(i, 0) AS interactions FROM art LEFT JOIN s ON article_id = l_orderkey WHERE status IN ('curated', 'reviewed', 'published')""")
def completion(spark, d):
    return tracking.completion(articles(spark, d), sessions(spark, d))


@query(f"WITH {ARTICLE} SELECT curator, count(*) AS total, sum(CASE WHEN status = 'in_progress' THEN 1 ELSE 0 END)::BIGINT AS active FROM art GROUP BY curator")
def workload(spark, d):
    return tracking.workload(articles(spark, d))


@query(f"WITH {ARTICLE} SELECT source_route, count(*) AS n FROM art GROUP BY source_route")
def route_counts(spark, d):
    return tracking.by_route(articles(spark, d))


@query("SELECT s_suppkey AS protein, n_name AS species_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0 AND n_name LIKE 'NATION_1%'")
def effectors(spark, d):
    proteins = table(spark, d, "supplier").select(F.col("s_suppkey").alias("protein"), F.col("s_nationkey").alias("species_id"), F.when(F.col("s_suppkey") % 3 == 0, "effector").otherwise("other").alias("protein_type"))
    species = table(spark, d, "nation").select(F.col("n_nationkey").alias("species_id"), F.col("n_name").alias("species_name"))
    return tracking.effectors(proteins, species, "NATION_1%").select("protein", "species_name")


@query("""SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 4 = 0 THEN 'captions only' ELSE 'figures unread' END AS why FROM orders
WHERE o_orderkey % 4 = 0 OR coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END, 0) < o_custkey % 4""")
def unread(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("article_id"), F.when(k % 4 == 0, 0).otherwise(1).alias("figures_available"), F.when(k % 3 != 0, k % 5).alias("figures_inspected"), (F.col("o_custkey") % 4).alias("figures_total"))
    return tracking.unread_figures(rows).select("article_id", "why")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) SELECT o_custkey, o_orderkey, place FROM r WHERE place <= 3""")
def latest(spark, d):
    return tracking.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""WITH a AS (SELECT c_nationkey, min(c_custkey) AS id FROM customer GROUP BY c_nationkey)
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, a.id) AS article_id FROM orders LEFT JOIN a ON o_orderkey % 40 = c_nationkey""")
def match_article(spark, d):
    """By number for even orders, else by the second key, which may find nothing."""
    arts = table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"), F.col("c_custkey").alias("pmid"), F.col("c_nationkey").cast("long").alias("note"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("pmid"), (F.col("o_orderkey") % 40).alias("note"))
    return tracking.match_article(rows, arts, ["pmid", "note"]).select("o_orderkey", "article_id")


# ---- documents and catalog ----------------------------------------------

PAGES = """pg AS (SELECT conv_id AS doc, turn AS page, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations)"""


@query(f"""WITH {PAGES}, o AS (SELECT doc, page AS asked, start + (n // 2) AS off FROM pg)
SELECT o.doc, o.asked AS offset_id, max(pg.page) AS page FROM o JOIN pg ON pg.doc = o.doc AND pg.start <= o.off GROUP BY o.doc, o.asked""")
def page_of_offset(spark, d):
    """Turns of a conversation as pages of a document; the middle of each is asked for."""
    pages = documents.page_offsets(table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))
    asked = pages.select("doc", F.col("page").alias("offset_id"), (F.col("start") + F.floor(F.length("text") / 2)).alias("offset"))
    return documents.page_of(asked, pages)


@query("SELECT l_orderkey AS doc, l_linenumber AS page, count(*) AS n_tables, count(*) > 1 AS shared FROM lineitem GROUP BY l_orderkey, l_linenumber")
def shared_page(spark, d):
    line = table(spark, d, "lineitem")
    rows = documents.shared_pages(line.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")), shares_of(line))
    return rows.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n_tables"), F.bool_or("shared").alias("shared"))


@query(r"""WITH s AS (SELECT doc_id AS doc, length(text) AS n, strpos(text, chr(10)) - 1 AS a, strpos(text, ' the ') - 1 AS b FROM documents),
r AS (SELECT doc, n, 'line' AS section, a AS start FROM s WHERE a >= 0 UNION ALL SELECT doc, n, 'the', b FROM s WHERE b >= 0)
SELECT doc, section, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, section), n) AS "end" FROM r""")
def section_bounds(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    found = documents.section_bounds(docs, {"line": "\n", "the": " the "})
    return found.select("doc", "section", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS label FROM lineitem), f AS (SELECT doc, label, label <> 7 AS listed, label <> 1 AS logged, label % 2 = 0 AS ticked, label % 4 = 0 AS done, label = 5 AS cited FROM x),
c AS (SELECT doc, max(CASE WHEN listed THEN 1 ELSE 0 END) AS has, sum(CASE WHEN listed THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN logged THEN 1 ELSE 0 END)::BIGINT AS m, sum(CASE WHEN listed AND NOT logged THEN 1 ELSE 0 END)::BIGINT AS missing,
  sum(CASE WHEN logged AND NOT listed THEN 1 ELSE 0 END)::BIGINT AS unknown, sum(CASE WHEN logged AND done THEN 1 ELSE 0 END)::BIGINT AS inspected, sum(CASE WHEN logged AND ticked AND NOT done THEN 1 ELSE 0 END)::BIGINT AS claimed, sum(CASE WHEN cited THEN 1 ELSE 0 END)::BIGINT AS req, sum(CASE WHEN label = 3 THEN 1 ELSE 0 END)::BIGINT AS declined, sum(CASE WHEN label IN (2, 3) THEN 1 ELSE 0 END)::BIGINT AS opt FROM f GROUP BY doc)
SELECT doc, CASE WHEN has = 1 THEN n ELSE m END AS total, missing, CASE WHEN has = 1 THEN unknown ELSE 0 END AS unknown, inspected, claimed AS claimed_not_read, req AS required_uninspected, CASE WHEN has = 1 AND m > 0 THEN declined ELSE declined END AS declined, opt AS optional_uninspected, m > 0 AND req = 0 AND claimed = 0 AS complete FROM c""")
def figure_audit(spark, d):
    n = F.col("label")
    line = table(spark, d, "lineitem")
    every = dealt(line.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("label")), shares := shares_of(line), "doc", "label").distinct()
    log = every.where("label <> 1").withColumns({"inspected": n % 2 == 0, "read": F.when(n % 4 == 0, "seen").otherwise(" "), "note": F.when(n == 3, "not needed")})
    roster = every.where("label <> 7").withColumns({"openable": n != 4, "tokens": n * 100})
    return documents.figure_audit(roster, log, every.where("label in (2, 3, 4, 5)").withColumn("required", n == 5), shares).drop("not_openable", "has_ledger")


@query("""WITH r AS (SELECT p_brand AS doc, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n, p_name AS base FROM part)
SELECT doc, seq, CASE WHEN n = 1 THEN base WHEN n <= 26 THEN base || chr(CAST(96 + n AS INTEGER)) ELSE base || '-' || (n - 25) END AS name FROM r""")
def unique_names(spark, d):
    return documents.unique_names(table(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("base"))).select("doc", "seq", "name")


def said_lines() -> Column:
    """The lines of a document that begin with a letter or a number, white space collapsed."""
    one = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\t\\x0B\\x0C\\r\\x1C-\\x1F\\x85\\p{Z}]+", " ")
    return F.filter(F.transform(F.split(one, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[\\p{L}\\p{N}]"))


def caption_number(i: Column) -> Column:
    """Every ninth is supplementary."""
    return F.concat(F.when(i % 9 == 0, "S").otherwise(""), (i + 1).cast("string"))


def captioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines, whole, are captions of figures and tables; some end in
    what conversion leaves: a page number, a note."""
    left = lambda i: F.when(i % 11 == 0, " 12").when(i % 7 == 0, ". (see text)").when(i % 5 == 0, " (Color online)").otherwise("")
    said = F.transform(said_lines(), lambda x, i: F.concat(F.when(i % 3 == 0, "Table ").when(i % 3 == 1, "Figure ").otherwise("Fig. "), caption_number(i), F.lit(". "), x, left(i)))
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array_join(said, "\n\n").alias("text"))


def caption_sql(source: str, out: str) -> str:
    """What is left of captions ``c`` of a table, and how sure each is."""
    return rf"""{out}1 AS (SELECT * EXCLUDE (c), trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '^[^\pL\pN_]+', ''), ' +\p{{Nd}}+ *$', ''), '\([Cc]olor online\)', '', 'g'), '[. ]*\([Ss]ee [Tt]ext\)', '', 'g'), ' +', ' ', 'g'), ' ') AS c FROM {source}),
{out}2 AS (SELECT * EXCLUDE (c), CASE WHEN length(c) <= 800 THEN c WHEN len(regexp_split_to_array(c, '[.!?]+')) > 1 THEN array_to_string(regexp_split_to_array(c, '[.!?]+')[1:3], '. ') || '.' ELSE substr(c, 1, 800) || '...' END AS c FROM {out}1),
{out} AS (SELECT *, length(c) AS length,
  round(greatest(0, least(1, (CASE WHEN length(c) > 10 THEN 0.5 ELSE 0 END) + (CASE WHEN regexp_matches(number, '^[0-9]') THEN 0.3 ELSE 0 END) + (CASE WHEN length(c) BETWEEN 20 AND 300 THEN 0.2 ELSE 0 END) - (CASE WHEN length(c) < 20 OR length(c) > 500 THEN 0.2 ELSE 0 END) + (CASE WHEN c LIKE '%.' THEN 0.1 ELSE 0 END)
   + (CASE WHEN regexp_matches(lower(c), 'showing|demonstrating|illustrating|depicting|represents|indicates|analysis|comparison|effect') THEN 0.2 ELSE 0 END))), 2) AS confidence
  FROM {out}2 WHERE length(c) > CASE WHEN kind = 'table' THEN 5 ELSE 10 END)"""


SAID = r"""ln AS (SELECT doc_id AS doc, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[\t\x0b\x0c\r\x1c-\x1f\x{85}\pZ]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '^[\pL\pN]')) AS l FROM documents),
cu AS (SELECT doc, unnest(l) AS line, unnest(range(len(l))) AS i FROM ln)"""

CAPTIONS = SAID + r""",
cl AS (SELECT doc, i, CASE WHEN i % 3 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN i % 9 = 0 THEN 'S' ELSE '' END || (i + 1) AS number, line || CASE WHEN i % 11 = 0 THEN ' 12' WHEN i % 7 = 0 THEN '. (see text)' WHEN i % 5 = 0 THEN ' (Color online)' ELSE '' END AS c FROM cu),
""" + caption_sql("cl", "cap")


@query(f"WITH {CAPTIONS} SELECT doc, kind, number, length, CAST(confidence AS DOUBLE) AS confidence FROM cap")
def captions(spark, d):
    """Captions of documents whose lines are taken for captions of numbered figures."""
    return documents.best_captions(documents.captions(captioned(spark, d))).select("doc", "kind", "number", F.length("caption").cast("long").alias("length"), "confidence")


@query(f"""WITH {SAID}, cl AS (SELECT doc, i, unnest([0, 1]) AS k, 'figure' AS kind, line AS c0 FROM cu), cs AS (SELECT doc, i, k, kind, CAST(i + 1 AS VARCHAR) AS number, c0 || CASE WHEN k = 1 THEN ' again, showing' ELSE '' END AS c FROM cl), {caption_sql("cs", "cap")},
w AS (SELECT *, list_distinct(regexp_split_to_array(lower(c), ' +')) AS w FROM cap),
p AS (SELECT x.doc, x.i, x.k, EXISTS (SELECT 1 FROM w y WHERE y.doc = x.doc AND y.i = x.i AND y.k <> x.k AND (y.confidence > x.confidence OR (y.confidence = x.confidence AND y.k < x.k))
  AND len(list_intersect(x.w, y.w)) > 0.8 * len(list_distinct(list_concat(x.w, y.w)))) AS gone, x.length, x.confidence FROM w x)
SELECT doc, CAST(i + 1 AS VARCHAR) AS number, length, CAST(confidence AS DOUBLE) AS confidence FROM p WHERE NOT gone""")
def caption_dedupe(spark, d):
    """Every caption comes twice, the second time with a word or two more; where the two
    are alike the surer one stays."""
    lines = said_lines()
    each = lambda more: F.transform(lines, lambda x, i: F.concat(F.lit("Figure "), (i + 1).cast("string"), F.lit(". "), x, F.lit(more)))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array_join(F.concat(each(""), each(" again, showing")), "\n\n").alias("text"))
    return documents.best_captions(documents.captions(docs)).select("doc", "number", F.length("caption").cast("long").alias("length"), "confidence")


@query("""SELECT n_nationkey AS species, count(s_suppkey) AS n, count(s_suppkey) > 0 AS covered FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def type_coverage(spark, d):
    vocabulary, records = table(spark, d, "nation").select(F.col("n_nationkey").alias("species")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("species"))
    return catalog.coverage(vocabulary, records, "species")


@query("SELECT p_name, count(*) AS n FROM part WHERE p_name NOT IN ('red widget') GROUP BY p_name HAVING count(*) > 1")
def dup_names(spark, d):
    return catalog.duplicates(table(spark, d, "part"), "p_name", ("red widget",))


@query(r"SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\s+')) > 40 AS over_cap FROM documents")
def word_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", catalog.over_word_cap(F.col("text")).alias("over_cap"))


@query("""WITH o AS (SELECT p_brand AS name, count(*) AS t, min(p_partkey) AS g FROM part GROUP BY p_brand), n AS (SELECT p_brand AS name, count(*) AS t, min(p_partkey) AS g FROM part WHERE p_size > 25 AND p_brand <> 'Brand#1' GROUP BY p_brand)
SELECT coalesce(o.name, n.name) AS name, o.t AS old_terms, n.t AS new_terms, CASE WHEN n.t IS NULL THEN 'removed' WHEN n.t * 2 < o.t THEN 'rejected' WHEN o.g = n.g THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.name = n.name""")
def snapshot_diff(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("name"), "p_partkey", "p_size")
    listing = lambda df: df.groupBy("name").agg(F.min("p_partkey").alias("digest"), F.count(F.lit(1)).alias("n_terms"))
    return catalog.snapshot_diff(listing(part), listing(part.where("p_size > 25 and name <> 'Brand#1'")))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 3 ELSE 5 END AS rank, o_orderstatus FROM orders),
l AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS flagged FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_returnflag FROM lineitem) x GROUP BY l_orderkey)
SELECT o_orderkey AS draft, rank AS triage_rank, coalesce(ok, 0) AS n_ok, coalesce(flagged, 0) AS n_flagged FROM r LEFT JOIN l ON o_orderkey = l_orderkey""")
def batch_review(spark, d):
    """Drafts whose checks are maps from line to verdict."""
    verdict = F.when(F.col("f") == "A", "ok, fine").when(F.col("f") == "R", "FLAG it").otherwise("none")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"))
    checks = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), verdict))).alias("m"))
    p = F.col("o_orderpriority")
    triage = F.when(p == "1-URGENT", "needs_human_decision").when(p == "2-HIGH", "in_scope").otherwise("nonsense")
    both = table(spark, d, "orders").join(checks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    signal = catalog.check_signal(F.col("m"))
    return both.select(F.col("o_orderkey").alias("draft"), catalog.triage_rank(triage).alias("triage_rank"), signal.n_ok.cast("long").alias("n_ok"), signal.n_flagged.cast("long").alias("n_flagged"))


@query("""WITH v AS (SELECT unnest(['needs_human_decision', 'scope_uncertain', 'partial', 'in_scope', 'out_of_scope', 'unspecified']) AS triage, unnest(range(6)) AS r), t AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'needs_human_decision' WHEN '2-HIGH' THEN 'partial' WHEN '5-LOW' THEN 'odd' ELSE 'unspecified' END AS triage, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(v.triage, t.triage) AS triage, coalesce(r, 5)::INT AS triage_rank, coalesce(n, 0) AS n FROM v FULL JOIN t ON v.triage = t.triage""")
def triage_tally(spark, d):
    verdict = F.when(F.col("o_orderpriority") == "1-URGENT", "needs_human_decision").when(F.col("o_orderpriority") == "2-HIGH", "partial").when(F.col("o_orderpriority") == "5-LOW", "odd")
    return catalog.triage_tally(table(spark, d, "orders").select(verdict.alias("triage")))


@query("SELECT l_returnflag AS category, l_orderkey AS draft, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_orderkey UNION ALL SELECT l_returnflag, NULL, count(*) FROM lineitem GROUP BY l_returnflag")
def flag_rollup(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_orderkey").alias("draft")).groupingSets([["category", "draft"], ["category"]], "category", "draft").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT CASE WHEN contains(lower(text), ' the ') THEN 'english' WHEN contains(lower(text), ' der ') OR contains(lower(text), ' und ') THEN 'german' ELSE 'other' END AS category, count(*) AS n FROM documents GROUP BY 1""")
def classify_sessions(spark, d):
    category = catalog.classify_by_keywords(F.col("text"), [("english", (" the ",)), ("german", (" der ", " und "))], "other")
    return table(spark, d, "documents").select(category.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT e AS error, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT (c_acctbal > 0) THEN 'balance' END, CASE WHEN NOT c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'segment' END]) AS e FROM customer) x WHERE e IS NOT NULL GROUP BY e""")
def contract_check(spark, d):
    errors = catalog.contract_errors({"balance": F.col("c_acctbal") > 0, "segment": F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY")})
    return table(spark, d, "customer").select(F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def only_new(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.only_new(table(spark, d, "orders").select("o_custkey"), known, "o_custkey").distinct()



# ---- records -------------------------------------------------------------

ROUTED = r"""g AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' JATS' WHEN 2 THEN 'pdf' WHEN 3 THEN 'europepmc' ELSE 'web' END AS given,
  CASE page_id % 7 WHEN 0 THEN 'in/a.b.PDF' WHEN 1 THEN 'x.nxml' WHEN 2 THEN 'in/x.xml' WHEN 3 THEN 'in.pdf/notes' ELSE NULL END AS file,
  CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS seen FROM pages),
t AS (SELECT *, coalesce(CASE given WHEN ' JATS' THEN 'jats-publisher' WHEN 'pdf' THEN 'pdf' WHEN 'europepmc' THEN 'jats-europepmc' END,
  CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jats-europepmc' WHEN 2 THEN 'jats-publisher' END) AS route FROM g)"""


@query(f"""WITH {ROUTED} SELECT page_id, coalesce(CASE route WHEN 'pdf' THEN 'PDF' WHEN 'jats-publisher' THEN 'publisher JATS XML' WHEN 'jats-europepmc' THEN 'Europe PMC JATS XML' END, regexp_replace(file, '^.*/', '')) AS label,
CASE WHEN route IS NULL AND file IS NULL THEN NULL WHEN seen THEN 'inspected' WHEN NOT seen THEN 'captions only' WHEN route IS NULL THEN 'not recorded' WHEN route = 'jats-publisher' THEN 'captions only' ELSE 'retrieved' END AS evidence,
coalesce(seen, given IN ('pdf', 'europepmc')) AS figures FROM t""")
def source_notes(spark, d):
    n = F.col("page_id")
    given = F.when(n % 5 == 0, "").when(n % 5 == 1, " JATS").when(n % 5 == 2, "pdf").when(n % 5 == 3, "europepmc").otherwise("web")
    file = F.when(n % 7 == 0, "in/a.b.PDF").when(n % 7 == 1, "x.nxml").when(n % 7 == 2, "in/x.xml").when(n % 7 == 3, "in.pdf/notes")
    seen = F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    rows = table(spark, d, "pages").select("page_id", validation.source_note(given, file, seen).alias("s"), validation.figures_available(given, seen).alias("figures"))
    return rows.select("page_id", "s.label", "s.evidence", "figures")


@query("""WITH c AS (SELECT DISTINCT p_type AS type, p_brand AS code FROM part WHERE p_size < 25), v AS (SELECT DISTINCT p_type AS type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE lower(substr(p_brand, 1, 7)) END AS value FROM part)
SELECT v.type, value, coalesce(bool_or(code = value), false) AS valid, CASE WHEN coalesce(bool_or(code = value), false) THEN 0 ELSE count(CASE WHEN contains(lower(code), lower(value)) THEN 1 END) END AS n_near,
CASE WHEN v.type = 'PROMO' THEN 'defaults only: unverified' END AS warning FROM v LEFT JOIN c ON v.type = c.type GROUP BY v.type, value""")
def vocabulary_check(spark, d):
    p = table(spark, d, "part")
    value = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lower(F.substring("p_brand", 1, 7)))
    codes = p.where("p_size < 25").select(F.col("p_type").alias("type"), F.col("p_brand").alias("code"))
    out = validation.one_vocabulary(p.select(F.col("p_type").alias("type"), value.alias("value")).distinct(), codes, F.col("type") == "PROMO")
    return out.select("type", "value", "valid", F.coalesce(F.size("did_you_mean"), F.lit(0)).cast("long").alias("n_near"), "warning")


VOCABS = "b AS (SELECT DISTINCT p_type AS vocab, p_brand AS value FROM part), o AS (SELECT DISTINCT p_type AS vocab, p_name AS value FROM part WHERE p_size > 45 AND p_type <> 'PROMO' UNION SELECT p_type, p_brand FROM part WHERE p_size > 45 AND p_type <> 'PROMO')"


def vocabularies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").withColumnRenamed("p_type", "vocab")
    named = p.where("p_size > 45 and vocab <> 'PROMO'")
    pick = lambda x, c: x.select("vocab", F.col(c).alias("value"))
    return pick(p, "p_brand").distinct(), pick(named, "p_name").unionByName(pick(named, "p_brand")).distinct()


@query(f"WITH {VOCABS} SELECT vocab, value FROM o UNION ALL SELECT vocab, value FROM b WHERE vocab NOT IN (SELECT vocab FROM o)")
def vocabulary_override(spark, d):
    return catalog.overridden(*vocabularies(spark, d))


@query(f"WITH {VOCABS} SELECT vocab, value, 'base_only' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM o) x UNION ALL SELECT vocab, value, 'override_only' FROM (SELECT * FROM o EXCEPT SELECT * FROM b) y")
def vocabulary_divergence(spark, d):
    return catalog.divergence(*vocabularies(spark, d), ["vocab", "value"])


GENOTYPES = r"""gt AS (SELECT l_orderkey AS draft, l_linenumber AS seq, CASE WHEN l_partkey % 20 = 0 THEN '' ELSE 'g' || l_linenumber END AS name, 'org' || (l_suppkey % 2) AS organism,
  CASE WHEN l_returnflag = 'A' THEN 'S' || (l_suppkey % 4) ELSE '' END AS strain, CASE WHEN l_partkey % 3 = 0 THEN 'bg' ELSE '' END AS background, l_linestatus = 'F' AS has_allele,
  CASE l_partkey % 4 WHEN 0 THEN 'host' WHEN 1 THEN 'pathogen' END AS role FROM lineitem),
k AS (SELECT *, has_allele OR background <> '' AS mutant FROM gt)"""


def line_genotypes(spark: SparkSession, d: str) -> DataFrame:
    line, part = table(spark, d, "lineitem"), F.col("l_partkey")
    number = F.col("l_linenumber").cast("string")
    return line.select(
        F.col("l_orderkey").alias("draft"), F.col("l_linenumber").cast("long").alias("seq"), F.when(part % 20 == 0, " ").otherwise(F.concat(F.lit("g"), number)).alias("name"),
        F.concat(F.lit("org"), (F.col("l_suppkey") % 2).cast("string")).alias("organism"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string"))).alias("strain"),
        F.when(part % 3 == 0, "bg").alias("background"), F.when(F.col("l_linestatus") == "F", F.array(F.lit("a1"))).otherwise(F.array(F.lit(" "))).alias("alleles"), F.when(part % 4 == 0, "host").when(part % 4 == 1, "pathogen").alias("role"),
    )


@query(f"""WITH {GENOTYPES} SELECT draft, seq, CASE WHEN name = '' THEN NULL WHEN strain <> '' AND background <> '' THEN 'both strain and background' WHEN mutant AND strain <> '' THEN 'mutant with a strain'
WHEN mutant AND background = '' THEN 'mutant without background' WHEN NOT mutant AND strain = '' THEN 'wild type without strain' END AS problem FROM k""")
def strain_lint(spark, d):
    problem = drafts.strain_problem(*map(F.col, ("name", "strain", "background", "alleles")))
    return line_genotypes(spark, d).select("draft", "seq", problem.alias("problem"))


@query(f"""WITH {GENOTYPES}, genes AS (SELECT o_orderkey AS draft, 'org0' AS organism FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT draft, organism, arg_max(role, 2 * seq + (role = 'pathogen')::INT) FILTER (role IS NOT NULL) AS used, count(DISTINCT CASE WHEN NOT mutant AND strain <> '' THEN strain END) AS n_strains, count(CASE WHEN NOT mutant AND strain = '' AND name <> '' THEN 1 END) AS n_wild FROM k GROUP BY draft, organism)
SELECT coalesce(r.draft, genes.draft) AS draft, coalesce(r.organism, genes.organism) AS organism, coalesce(used, CASE WHEN genes.draft IS NOT NULL THEN 'pathogen' END) AS role, coalesce(n_strains, 0) AS n_strains, coalesce(n_wild, 0) AS n_wild
FROM r FULL JOIN genes ON r.draft = genes.draft AND r.organism = genes.organism""")
def organism_rollup(spark, d):
    genes = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("draft"), F.lit("org0").alias("organism"))
    out = drafts.organism_rollup(genes, line_genotypes(spark, d))
    return out.select("draft", "organism", "role", F.size("strains").cast("long").alias("n_strains"), F.size("wild_types").cast("long").alias("n_wild"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS draft, l_returnflag || l_linestatus AS type, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS pos FROM lineitem)
SELECT draft, type, row_number() OVER (PARTITION BY draft ORDER BY pos, type) AS n FROM p""")
def section_numbers(spark, d):
    at = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft"), F.concat("l_returnflag", "l_linestatus").alias("type"), at.alias("at"))
    return drafts.section_numbers(rows, "at").withColumn("n", F.col("n").cast("long"))


@query("""SELECT o_orderkey AS draft, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_name END, 'draft ' || o_orderstatus) AS title, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN split_part(c_mktsegment, ' ', 1) END, 'nobody') AS first_author,
CASE WHEN c_custkey IS NULL THEN '1999' WHEN c_nationkey > 20 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS year FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def citation_enrich(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    known = c.select(F.col("c_custkey").alias("pmid"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise("").alias("title"), F.when(F.col("c_custkey") % 3 != 0, F.concat("c_mktsegment", F.lit(", B. and others"))).alias("authors"), F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("pub_year"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft"), F.col("o_custkey").alias("pmid"), F.concat(F.lit("draft "), "o_orderstatus").alias("title"), F.lit("nobody").alias("first_author"), F.lit("1999").alias("year"))
    return tracking.with_citation(rows, known).drop("pmid")


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def _number(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")"


@query(f"""WITH l AS (SELECT lower(text) AS low FROM conversations UNION ALL SELECT lower(text) FROM documents)
SELECT {_number(catalog.DEVELOPMENT)} > {_number(catalog.CONTENT)} OR {_any(catalog.DECISIVE)} AS development, CASE {' '.join(f"WHEN {_any(w)} THEN '{k}'" for k, w in catalog.CATEGORIES)} ELSE 'System Enhancement' END AS category, count(*) AS n FROM l GROUP BY 1, 2""")
def session_kinds(spark, d):
    texts = table(spark, d, "conversations").select("text").unionByName(table(spark, d, "documents").select("text"))
    return texts.select(catalog.session_kind(F.col("text")).alias("s")).groupBy("s.development", "s.category").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT coalesce(source, '?') AS type, count(*) AS n FROM documents GROUP BY 1) SELECT type, n, row_number() OVER (ORDER BY n DESC, encode(type)) AS place FROM c")
def mention_types(spark, d):
    return catalog.counts_by_type(table(spark, d, "documents"), "source").withColumn("place", F.col("place").cast("long"))


DONE = r"""art AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS pmid, CASE WHEN o_orderkey % 3 = 1 THEN 'n' || o_custkey ELSE '' END AS note, 't' || o_orderkey AS title FROM orders),
dn AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS pmid, 'n' || c_custkey AS note, 't' || c_nationkey AS title FROM customer),
m AS (SELECT k, coalesce((SELECT min(id) FROM art WHERE art.pmid = dn.pmid AND art.pmid <> ''), (SELECT min(id) FROM art WHERE art.note = dn.note AND art.note <> ''), (SELECT min(id) FROM art WHERE art.title = dn.title)) AS id FROM dn)"""


def completed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    known = table(spark, d, "orders").select(k.alias("article_id"), F.when(k % 3 == 0, c).alias("pmid"), F.when(k % 3 == 1, F.concat(F.lit("n"), c)).alias("note_path"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.lit("queued").alias("status"))
    who = F.col("c_custkey").cast("string")
    done = table(spark, d, "customer").select(F.col("c_custkey").alias("session"), F.when(F.col("c_custkey") % 5 != 0, who).alias("pmid"), F.concat(F.lit("n"), who).alias("note_path"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("title"))
    return tracking.record_completion(known, done)


@query(f"WITH {DONE} SELECT id AS article_id, CASE WHEN id IN (SELECT id FROM m WHERE id IS NOT NULL) THEN 'curated' ELSE 'queued' END AS status, NULL AS note_path FROM art UNION ALL SELECT NULL, 'curated', 'n' || k FROM m WHERE id IS NULL")
def record_completion(spark, d):
    after, _ = completed(spark, d)
    old = F.col("article_id") >= 0  # the others are new, with a hash for an id
    return after.select(F.when(old, F.col("article_id")).alias("article_id"), "status", F.when(~old, F.col("note_path")).alias("note_path"))


@query(f"WITH {DONE} SELECT k AS session, id AS article_id, id IS NULL AS created FROM m")
def completion_sessions(spark, d):
    _, done = completed(spark, d)
    return done.select("session", F.when(~F.col("created"), F.col("article_id")).alias("article_id"), "created")


@query("""WITH c AS (SELECT l_orderkey AS k, arg_max(CASE l_returnflag WHEN 'A' THEN 'reviewed' ELSE 'published' END, 2 * l_linenumber + (l_returnflag = 'A')::INT) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
SELECT o_orderkey AS article_id, coalesce(s, 'queued') AS status FROM orders LEFT JOIN c ON o_orderkey = k""")
def status_updates(spark, d):
    flag = F.col("l_returnflag")
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.when(flag == "A", "reviewed").when(flag == "R", "no such status").otherwise("published").alias("status"), F.col("l_linenumber").alias("seq"))
    return tracking.set_status(table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.lit("queued").alias("status")), changes)


NOTES = r"""l AS (SELECT conv_id AS doc, turn, role, coalesce(max(CASE WHEN turn % 4 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS head FROM conversations)"""


@query(f"""WITH {NOTES} SELECT doc, sum((turn % 4 = 1 AND role = 'user' AND head >= 0 AND (doc + head // 4) % 2 = 0)::INT)::BIGINT AS interactions,
count(DISTINCT CASE WHEN turn % 4 = 3 THEN doc % 3 END) AS accessions, count(CASE WHEN turn % 4 = 3 THEN 1 END) AS locus_tags, count(CASE WHEN turn % 4 = 3 THEN 1 END) AS terms,
count(DISTINCT CASE WHEN turn % 4 = 3 THEN doc % 3 END) + count(CASE WHEN turn % 4 = 3 THEN 1 END) AS proteins FROM l GROUP BY doc""")
def completion_counts(spark, d):
    """Notes put together of a conversation's turns: headings, bullets, placeholders, identifiers."""
    t, doc = F.col("turn"), F.col("conv_id")
    heading = F.when((doc + F.floor(t / 4)) % 2 == 0, "## Host interactions").otherwise("## Methods")
    said = F.concat(F.lit("see go:000000"), t.cast("string"), F.lit(", UniProt:P0000"), (doc % 3).cast("string"), F.lit(" and UniProtKB:p0000"), (doc % 3).cast("string"), F.lit(", AB_100"), t.cast("string"))
    line = F.when(t % 4 == 0, heading).when(t % 4 == 1, F.when(F.col("role") == "user", "- A binds B").otherwise("- ")).when(t % 4 == 2, " * {{todo}} ").otherwise(said)
    notes = table(spark, d, "conversations").groupBy(doc.alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(t, line.alias("line")))), lambda x: x.line), "\n").alias("text"))
    return documents.completion_counts(notes).drop("text")


@query(r"""SELECT page_id, CASE WHEN page_id % 4 <> 0 AND page_id % 3 > 0 THEN 'jats-europepmc' WHEN page_id % 2 = 0 THEN 'jats-publisher' ELSE 'pdf' END AS route FROM pages""")
def reported_routes(spark, d):
    n = F.col("page_id")
    given = validation.source_route(F.lit(None).cast("string"), F.when(n % 2 == 0, "a/b.xml").otherwise("c.pdf"))
    pmcid = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("PMC"), n.cast("string")))
    return table(spark, d, "pages").select("page_id", validation.reported_route(given, pmcid, F.nullif(n % 3, F.lit(0))).alias("route"))
