"""Readers over small files written here."""

import json

import pytest

from scriptorium.operators import catalog
from scriptorium.sources import articles, readers

OBO = """format-version: 1.2
data-version: releases/2024-05

[Term]
id: X:0000001
name: pale spores
synonym: "light \\"spores\\"" EXACT []
subset: qc_do_not_annotate
is_a: X:0000009 ! parent

[Typedef]
id: X:part_of

[Term]
id: X:0000002
name: obsolete thing

[Term]
id: X:0000003
name: gone
is_obsolete: true
subset: Grouping_terms

[Term]
id: Y:1
name: other
"""


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text(OBO)
    got = {r.term_id: r for r in readers.read_obo(spark, str(tmp_path), "X").collect()}
    assert sorted(got) == ["X:0000001", "X:0000002", "X:0000003"]
    r = got["X:0000001"]
    assert r.synonyms == ['light \\"spores\\"'] and r.subsets == ["qc_do_not_annotate"] and r.is_a == ["X:0000009"] and not r.obsolete
    assert got["X:0000002"].obsolete and got["X:0000003"].obsolete
    assert {r.term_id for r in readers.read_obo(spark, str(tmp_path), "X", label_marks_obsolete=False).collect() if r.obsolete} == {"X:0000003"}
    assert [r.term_id for r in readers.read_obo(spark, str(tmp_path), "X", annotatable_only=True).collect()] == ["X:0000001"]
    assert readers.obo_release(spark, str(tmp_path)).first().release == "releases/2024-05"


def test_release(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿Record ID,Gene_name,PMID,Literature_source\nRecord ID,Gene_name,PMID,Literature_source\n1,"a, b",11,Pubmed\n2,c,ISBN 5,Book\n3,d,11,pubmed\n', encoding="utf-8")
    got = readers.read_release(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(r.record_id, r.gene, r.pmid, r.host) for r in got] == [("1", "a, b", "11", None), ("2", "c", "ISBN 5", None), ("3", "d", "11", None)]


def test_drafts_and_turns(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.md").write_text('# A\n```json\n{"meta": {"pmid": "1"}, "triage": "in_scope", "flags": [{"category": "x"}]}\n```\n```json\n{}\n```')
    (d / "b.md").write_text("no block")
    (d / "c.md").write_text("```json\n{broken\n```")
    got = {r.path[-4:]: (r.status, r.draft and r.draft.triage) for r in readers.read_drafts(spark, str(d)).collect()}
    assert (got["a.md"], got["b.md"], got["c.md"][0]) == (("ok", "in_scope"), ("skipped", None), "error")
    (d / "d.md").write_text('```json\n{"meta": {"pmid": 7, "draft_by": {"tool": "x"}}, "triage": ["a", "b"], "new_field": {"deep": [1, 2.5]}, "canto": {"genes": [{"name": "g", "odd": true}]}}\n```')
    (r,) = readers.read_drafts(spark, str(d / "d.md")).select(
        "status", "draft", *[readers.said_field(p, k).alias(n) for n, p, k in (("deep", "$.new_field.deep[1]", "double"), ("second", "$.triage[1]", "string"), ("odd", "$.canto.genes[0].odd", "boolean"), ("tool", "$.meta.draft_by.tool", "string"), ("pmid", "$.meta.pmid", "int"), ("none", "$.a.b", "string"))]
    ).collect()
    assert (r.status, r.draft.meta.pmid, r.draft.canto.genes[0].name) == ("ok", "7", "g")
    assert (r.deep, r.second, r.odd, r.tool, r.pmid, r.none) == (2.5, "b", True, "x", 7, None)
    t = tmp_path / "t.jsonl"
    t.write_text('{"message": {"model": "m", "usage": {"input_tokens": 5}, "content": [{"type": "text", "text": "PMID 7"}]}}\nnot json\n{"message": {"content": "x"}}\n')
    (r,) = readers.read_turns(spark, str(t)).collect()
    assert (r.model, r.inp, r.out, r.cache_read) == ("m", 5, 0, 0) and "pmid 7" in r.blob


def test_turns_are_in_the_order_of_lines(spark, tmp_path):
    """Over many splits of two files."""
    said = lambda n: json.dumps({"message": {"model": "m", "usage": {"input_tokens": n}, "content": f"turn {n} " + "x" * (n * 7 % 90)}}) if n % 9 else "broken {"
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(said(n) for n in range(300)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = readers.read_turns(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.session[-7], r.turn, r.inp) for r in got) == [(f, n, n) for f in "ab" for n in range(300) if n % 9]


def test_small_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# no\n  a phrase \n\nb\n")
    assert [r.phrase for r in readers.read_phrases(spark, str(tmp_path / "p.txt")).collect()] == ["a phrase", "b"]
    (tmp_path / "t.md").write_text("text\n| a | b | c | d |\n|---|---|---|---|\n| 1 | 2 | 3 | 4 |\n")
    assert [r.cells for r in readers.read_pipe_table(spark, str(tmp_path / "t.md")).collect()] == [["a", "b", "c", "d"], ["1", "2", "3", "4"]]
    (tmp_path / "n.md").write_text("---\ntitle: 'A'\nempty: null\ntags:\n  - x\n  - y\n---\nbody\n")
    assert readers.read_frontmatter(spark, str(tmp_path / "n.md")).first().fields == {"title": ["A"], "empty": [], "tags": ["x", "y"]}
    (tmp_path / "e.tsv").write_text("domain ID\tsubset\trelation\trange\nGO:1\tis_a\thas_x \tPHIPO_EXT:1|%\tshown\nshort\trow\n")
    (r,) = readers.read_extension_config(spark, str(tmp_path / "e.tsv")).collect()
    assert (r.relation, r.range_id, r.display, r.role) == ("has_x", "PHIPO_EXT:1|%", "shown", None)
    (tmp_path / "pub.json").write_text('{"pmid": "1", "title": "a <i>b</i>", "isOpenAccess": "y", "journalInfo": {"journal": {"title": "J"}}}\n')
    r = readers.read_publications(spark, str(tmp_path / "pub.json")).first()
    assert (r.title, r.isOpenAccess, r.hasPDF, r.journal) == ("a b", True, False, "J")


XML = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta>
<article-id pub-id-type="pmid">12</article-id><title-group><article-title>Growth of <italic>Abx9</italic> spores</article-title></title-group>
<contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid">0-1</contrib-id><name><surname>Doe</surname><given-names>A</given-names></name><xref ref-type="corresp"/></contrib>
<contrib><string-name>The Group</string-name></contrib><contrib contrib-type="editor"><name><surname>Ed</surname></name></contrib></contrib-group>
<volume>7</volume><fpage>11</fpage><lpage>19</lpage><permissions><license><license-p>Free to <bold>use</bold></license-p></license></permissions><pub-date><year>2021</year></pub-date><pub-date><year>2020</year></pub-date></article-meta></front>
<body><p>Loose</p><sec><title>One</title><p>a<sup>2</sup> b</p><sec><title>Deep</title><p>c</p></sec></sec>
<fig id="f1"><label>Figure 1</label><caption><p>Cap</p></caption><graphic xlink:href="x.jpg"/></fig></body>
<back><fig id="f1"><label>again</label></fig><table-wrap id="t1"><table><tr><td>1</td><td>2</td></tr></table></table-wrap>
<ref-list><ref id="r1"><label>1</label><mixed-citation>Doe <bold>3</bold><pub-id pub-id-type="pmid">99</pub-id></mixed-citation></ref><ref id="r2"><label>2</label></ref></ref-list></back></article>"""


def test_vocabularies(spark, tmp_path):
    base, over = tmp_path / "base.json", tmp_path / "over.json"
    base.write_text('{"kinds": ["a", {"name": "b"}, {"other": 1}, 3], "states": ["x"], "gone": ["y"], "title": "t"}')
    over.write_text('{"states": [{"name": "z"}], "gone": []}')
    b, o = (readers.read_vocabularies(spark, str(p)).select("vocab", "value") for p in (base, over))
    got = catalog.overridden(b, o).where("value is not null").orderBy("vocab", "value").collect()
    assert [tuple(r) for r in got] == [("kinds", "a"), ("kinds", "b"), ("states", "z")]


def test_vocabularies_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("kinds:\n  - a\n  - name: b\n")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "list.yaml").write_text("- a\n")
    got = readers.read_vocabularies(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.vocab, r.value) for r in got] == [("kinds", "a"), ("kinds", "b")]


def ok(df):
    return df.where("status = 'ok'").drop("status")


def test_articles(spark):
    df = spark.createDataFrame([(1, XML), (2, "broken <"), (3, None), (4, "<article/>")], "doc long, xml string")
    (m,) = ok(articles.article_table(df.where("doc < 4"), "metadata")).collect()
    assert (m.pmid, m.title, m.journal, m.year, m.authors) == ("12", "Growth of *Abx9* spores", "J", "2021", ["A Doe", "The Group"])
    assert [tuple(c) for c in m.contributors] == [("A Doe", "0-1", True), ("The Group", None, False)]
    assert (m.volume, m.issue, m.first_page, m.last_page, m.elocation, m.license) == ("7", None, "11", "19", None, "Free to **use**")
    every = articles.article_table(df, "sections")
    assert [(s.ord, s.depth, s.title, s.blocks) for s in ok(every).collect()] == [(1, 1, "", ["Loose"]), (2, 1, "One", ["a^2^ b"]), (3, 2, "Deep", ["c"])]
    assert {r.doc: r.status for r in every.collect()} == {1: "ok", 2: "broken", 3: "broken", 4: "none"}
    assert [(o.object_id, o.kind, o.caption, o.graphics, o.rows) for o in ok(articles.article_table(df, "display_objects")).collect()] == [("f1", "figure", "Cap", ["x.jpg"], []), ("t1", "table", "", [], [["1", "2"]])]
    assert [(r.ref_id, r.citation, r.pmid) for r in ok(articles.article_table(df, "references")).collect()] == [("r1", "Doe **3**99", "99"), ("r2", "2", None)]


def test_archive_of_articles(spark, tmp_path):
    """Thousands of articles in one file, read by several tasks; broken ones return."""
    one = XML.replace("\n", "")
    body = "".join(one.replace(">12<", f">{k}<") if k % 50 else f"<article><front>{k}</article>" for k in range(3000))
    wrapped = f'<?xml version="1.0"?><!DOCTYPE x SYSTEM "y.dtd"><set xmlns:q="r">{body}<article><q:p>prefix of the wrapper</q:p></article></set>\n'
    (tmp_path / "all.xml").write_text(wrapped)
    (tmp_path / "cut.xml").write_text("<article><body><p>cut off</p>")
    (tmp_path / "single.xml").write_text('<?xml version="1.0"?>\n<!DOCTYPE article PUBLIC "a" "b">\n' + XML)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = articles.read_articles(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    name = lambda r: r.file.rpartition("/")[2]
    assert len({r.block for r in got if name(r) == "all.xml"}) > 10
    count = {}
    for r in got:
        count[name(r), r.status] = count.get((name(r), r.status), 0) + 1
    assert count == {("all.xml", "ok"): 2941, ("all.xml", "broken"): 60, ("cut.xml", "broken"): 1, ("single.xml", "ok"): 1}
    assert all((r.error is None) == (r.status == "ok") for r in got)
    again = articles.article_table(spark.createDataFrame([(i, r.xml) for i, r in enumerate(got)], "doc long, xml string"), "metadata")
    found = {r.pmid for r in again.where("status = 'ok'").collect()}
    assert found == {str(k) for k in range(3000) if k % 50} | {"12", None}
