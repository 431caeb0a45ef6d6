"""Article XML as tables: metadata, sections, display objects, references.

Archives hold many articles in a file.  They are read as records that end with the
article's end tag, so a large file is as many tasks as it has splits.  Mixed content
loses its order in a columnar XML reader, so each article is parsed whole by the
standard library within the task that reads it.  What is no XML is a row with the
status ``broken``.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptorium.functions.batches import pieces

MARKS = {"italic": "*", "i": "*", "bold": "**", "b": "**", "sup": "^", "sub": "~"}
DEEPEST = 6


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _kids(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e if _name(x) in names]


def _all(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) in names]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def inline(e: ET.Element | None) -> str:
    """Text with emphasis marks, in reading order, white space collapsed."""

    def walk(x: ET.Element) -> str:
        said = (x.text or "") + "".join(walk(k) + (k.tail or "") for k in x)
        mark = MARKS.get(_name(x))
        return f"{mark}{said.strip()}{mark}" if mark and said.strip() else said

    return "" if e is None else " ".join(walk(e).split())


def _caption(e: ET.Element) -> str:
    return " ".join(filter(None, (inline(x) for c in _kids(e, "caption") for x in c)))


def _first(e: ET.Element | None, *names: str) -> str:
    """The text of the first child of that name."""
    return inline(next(iter(_kids(e, *names)), None))


def contributors(meta: ET.Element) -> list[dict]:
    """Authors in order; other roles are left out, a contributor without one is an author."""
    out = []
    for c in _all(meta, "contrib"):
        if c.get("contrib-type", "author") != "author":
            continue
        n = next(iter(_all(c, "name")), None)
        name = " ".join(filter(None, (_first(n, k) for k in ("given-names", "surname")))) or _first(c, "string-name")
        if name:
            orcid = next((inline(x) for x in _kids(c, "contrib-id") if x.get("contrib-id-type") == "orcid"), None)
            corresponding = any(x.get("ref-type") == "corresp" for x in _kids(c, "xref"))
            out.append({"name": name, "orcid": orcid, "corresponding": corresponding})
    return out


def metadata(root: ET.Element) -> Iterator[tuple]:
    meta = next(iter(_all(root, "article-meta")), root)
    ids = {x.get("pub-id-type"): (x.text or "").strip() for x in _kids(meta, "article-id")}
    people = contributors(meta)
    years = [y for y in (_first(d, "year") for d in _kids(meta, "pub-date")) if y]
    title = next(iter(_all(meta, "article-title")), None)
    journal = next(iter(_all(root, "journal-title")), None)
    permit = next((x for p in _kids(meta, "permissions") for x in _kids(p, "license")), None)
    yield (
        *(ids.get("pmid"), ids.get("pmc") or ids.get("pmcid"), ids.get("doi")),
        *(inline(title), inline(journal), years[0] if years else None),
        *([c["name"] for c in people], [inline(k) for k in _all(meta, "kwd")]),
        inline(next(iter(_all(meta, "abstract")), None)),
        people,
        *(_first(meta, k) or None for k in ("volume", "issue", "fpage", "lpage", "elocation-id")),
        _first(permit, "license-p") or None,
    )


def sections(root: ET.Element) -> Iterator[tuple]:
    body = next(iter(_all(root, "body")), None)
    blocks = ("p", "list", "disp-quote", "disp-formula")
    order = 0

    def walk(sec: ET.Element, depth: int) -> Iterator[tuple]:
        nonlocal order
        title = inline(next(iter(_kids(sec, "title")), None))
        order += 1
        yield order, min(depth, DEEPEST), title, [inline(x) for x in _kids(sec, *blocks)]
        for s in _kids(sec, "sec"):
            yield from walk(s, depth + 1)

    loose = [inline(x) for x in _kids(body, *blocks)]
    if loose:
        order += 1
        yield order, 1, "", loose
    for s in _kids(body, "sec"):
        yield from walk(s, 1)


def display_objects(root: ET.Element) -> Iterator[tuple]:
    seen: set[str] = set()
    for e in _all(root, "fig", "table-wrap"):
        key = e.get("id") or f"#{len(seen)}"
        if key in seen:
            continue
        seen.add(key)
        label = inline(next(iter(_kids(e, "label")), None))
        rows = [[inline(c) for c in _kids(r, "td", "th")] for r in _all(e, "tr")]
        yield key, "figure" if _name(e) == "fig" else "table", label, _caption(e), [_attr(g, "href") for g in _all(e, "graphic")], rows


def references(root: ET.Element) -> Iterator[tuple]:
    for r in (r for ls in _all(root, "ref-list") for r in _kids(ls, "ref")):
        cite = next(iter(_kids(r, "element-citation", "mixed-citation", "citation")), None)
        label = inline(next(iter(_kids(r, "label")), None))
        pmid = None if cite is None else next((x.text for x in _kids(cite, "pub-id") if x.get("pub-id-type") == "pmid"), None)
        yield r.get("id"), label, inline(cite) if cite is not None else label, pmid


SHAPES: dict[str, tuple[Callable[[ET.Element], Iterator[tuple]], str]] = {
    "metadata": (metadata, "pmid string, pmcid string, doi string, title string, journal string, year string, authors array<string>, keywords array<string>, abstract string, contributors array<struct<name:string,orcid:string,corresponding:boolean>>, volume string, issue string, first_page string, last_page string, elocation string, license string"),
    "sections": (sections, "ord int, depth int, title string, blocks array<string>"),
    "display_objects": (display_objects, "object_id string, kind string, label string, caption string, graphics array<string>, rows array<array<string>>"),
    "references": (references, "ref_id string, label string, citation string, pmid string"),
}


END = "</article>"
_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")
_DECLARED = re.compile(r"xmlns:([A-Za-z_][\w.-]*)\s*=")


def parse_article(xml: str | None) -> tuple[ET.Element | None, str | None]:
    """(root, error).  Prefixes that an archive's wrapper declared are declared anew."""
    said = xml or ""
    try:
        return ET.fromstring(said), None
    except ET.ParseError as broken:
        if "unbound prefix" not in str(broken):
            return None, str(broken)
    missing = set(_PREFIX.findall(said)) - set(_DECLARED.findall(said)) - {"xml"}
    spaces = "".join(f' xmlns:{p}="{p}"' for p in sorted(missing))
    try:
        return ET.fromstring(re.sub(r"<([A-Za-z_][\w.:-]*)", lambda m: m[0] + spaces, said, count=1)), None
    except ET.ParseError as broken:
        return None, str(broken)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, xml, status, error): every article of XML files, archives of many
    or files of one, with the split in which its text ends.

    An article runs from its start tag to the next end tag; one that the file cuts
    off, or whose text is no XML, is ``broken``, and so is what stands between two
    articles if it holds a tag that neither a wrapper nor a declaration explains.
    """
    raw = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    from_tag = F.regexp_extract("value", r"(?s)<article[\s>/].*\z", 0)
    rest = F.regexp_replace("value", r"(?s)<[?!].*?>|</?[A-Za-z_][^<>]*>|\s+|\x{FEFF}", "")
    # a file's last record has no article, but the end of a wrapper
    there = raw.withColumn("from_tag", from_tag).where((F.col("from_tag") != "") | (rest != ""))
    whole = there.select("file", "block", F.when(F.col("from_tag") != "", F.concat("from_tag", F.lit(END))).otherwise(F.col("value")).alias("xml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "xml"):
                errors = [parse_article(x.as_py())[1] for x in part.column("xml")]
                status = ["ok" if e is None else "broken" for e in errors]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(status, pa.string()), pa.array(errors, pa.string())], names=["file", "block", "xml", "status", "error"])

    return whole.mapInArrow(run, "file string, block long, xml string, status string, error string")


def article_table(articles: DataFrame, what: str) -> DataFrame:
    """(doc, status, ...): rows of one of SHAPES for each article (doc, xml).  What is
    no XML has one row, with the status ``broken``; an article that has nothing of the
    kind has one with ``none``; all others are ``ok``."""
    walk, columns = SHAPES[what]
    kind = dict(articles.dtypes)["doc"]
    schema = StructType.fromDDL(f"doc {kind}, status string, {columns}")
    arrow = to_arrow_schema(schema)
    blank = (None,) * (len(arrow) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "xml"):
                rows: list[tuple] = []
                for doc, xml in zip(part.column("doc").to_pylist(), part.column("xml")):
                    root, error = parse_article(xml.as_py())
                    if error is not None:
                        rows.append((doc, "broken", *blank))
                        continue
                    before = len(rows)
                    rows += [(doc, "ok", *r) for r in walk(root)]
                    if len(rows) == before:
                        rows.append((doc, "none", *blank))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return articles.select("doc", "xml").mapInArrow(run, schema)
