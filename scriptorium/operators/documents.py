"""Converted papers: pages, sections, captions, figures and media."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptorium.functions.batches import pieces
from scriptorium.functions.identifiers import extract_ids
from scriptorium.functions.shares import dealt
from scriptorium.functions.text import locus_tags, strip


def page_offsets(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, page, text) with start: where it begins in the joined text."""
    before = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def page_of(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """``offsets`` (doc, offset) with the page each lies on: an as-of join by a
    running last value, one sort per document; before the first page counts as it."""
    marks = pages.select("doc", F.col("start").alias("at"), "page", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("offset_id"))
    asked = offsets.select("doc", F.greatest(F.col("offset"), F.lit(0)).alias("at"), F.lit(None).cast(dict(pages.dtypes)["page"]).alias("page"), F.lit(1).alias("kind"), "offset_id")
    run = W.partitionBy("doc").orderBy("at", "kind", "page").rowsBetween(W.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(run)).where("kind = 1").select("doc", "offset_id", "page")


def shared_pages(tables: DataFrame, shares: int | None = None) -> DataFrame:
    return dealt(tables, shares, "doc", "page").withColumn("shared", F.count(F.lit(1)).over(W.partitionBy("doc", "page")) > 1)


def section_bounds(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc, section, start, end): the first match of each pattern, up to the next
    section's start or the text's end; offsets from 0."""
    found = F.array(*[F.struct(F.lit(k).alias("section"), (F.regexp_instr("text", F.lit(p)) - 1).alias("start")) for k, p in patterns.items()])
    rows = docs.select("doc", F.length("text").alias("n"), F.explode(F.filter(found, lambda s: s.start >= 0)).alias("s"))
    end = F.lead("s.start").over(W.partitionBy("doc").orderBy("s.start", "s.section"))
    return rows.select("doc", "s.section", "s.start", F.coalesce(end, "n").alias("end"))


#: A caption begins with its kind and number, anywhere, and goes on to the line's end.
_CAPTION = re.compile(r"\b(?P<kind>figure|fig\.?|table)\s+(?P<number>\d+[a-z]*|S\d+[a-z]*|(?-i:[IVXL]+)\b)[:\-.\s–]*(?P<text>[^\n]*)", re.I)
# Least lengths, what is left out of captions, words that describe, and what speaks for a caption.
LEAST_LENGTH = {"figure": 10, "table": 5}
ARTIFACTS = (r"^\W+", r"\s+\d+\s*$", r"\([Cc]olor online\)", r"\([Cc]olour figure can be viewed at.*?\)", r"[.\s]*\([Ss]ee [Tt]ext\)")
DESCRIPTIVE = ("showing", "demonstrating", "illustrating", "depicting", "represents", "indicates", "analysis", "comparison", "effect")
LONGEST_CAPTION, SURE = 800, {"text": 0.5, "label": 0.3, "good length": 0.2, "odd length": -0.2, "full stop": 0.1, "descriptive": 0.2}


def clean_caption(text: str) -> str:
    """Without artifacts; of a very long one three sentences."""
    text = re.sub(ARTIFACTS[0], "", " ".join(text.split()))
    if text[-1:].isdecimal():  # the number of a page stands at the end
        text = re.sub(ARTIFACTS[1], "", text)
    for pattern in ARTIFACTS[2:] if "(" in text else ():
        text = re.sub(pattern, "", text)
    text = " ".join(text.split())
    if len(text) <= LONGEST_CAPTION:
        return text
    sentences = re.split("[.!?]+", text)
    return ". ".join(sentences[:3]) + "." if len(sentences) > 1 else text[:LONGEST_CAPTION] + "..."


def caption_confidence(number: str, caption: str) -> float:
    """Between 0 and 1; Roman and supplementary numbers don't make a good label."""
    n, low = len(caption), caption.lower()
    holds = {
        "text": n > 10, "label": number[:1].isdigit(), "good length": 20 <= n <= 300, "odd length": n < 20 or n > 500,
        "full stop": caption.endswith("."), "descriptive": any(w in low for w in DESCRIPTIVE),
    }
    return round(min(1.0, max(0.0, sum(SURE[k] for k, held in holds.items() if held))), 2)


def captions(docs: DataFrame) -> DataFrame:
    """(doc, kind, number, caption, start, end, confidence) of texts (doc, text)."""

    schema = StructType.fromDDL(f"doc {dict(docs.dtypes)['doc']}, kind string, number string, caption string, start int, end int, confidence double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text")):
                    for m in _CAPTION.finditer(text.as_py() or ""):
                        kind, said = "table" if m["kind"].lower() == "table" else "figure", clean_caption(m["text"])
                        if (kind == "table" or m["number"][0].isdigit()) and len(said) > LEAST_LENGTH[kind]:
                            rows.append((doc, kind, m["number"], said, m.start(), m.end(), caption_confidence(m["number"], said)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select("doc", "text").mapInArrow(run, schema)


def best_captions(found: DataFrame, alike: float = 0.8) -> DataFrame:
    """Without captions that repeat a more certain one of their number: greedily,
    most certain first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("doubt"), "start", "end", "caption", "confidence")))
    by = found.groupBy("doc", "kind", "number").agg(order.alias("all"))
    # each caption's words are taken once, and only where there is another to compare with
    worded = lambda every: F.transform(every, lambda x: F.struct(x.alias("c"), F.array_distinct(F.split(F.lower(x.caption), r"\s+")).alias("words")))

    def near(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return both > alike * (F.size(a) + F.size(b) - both)

    fold = F.aggregate(worded(F.col("all")), worded(F.slice("all", 1, 0)), lambda acc, x: F.when(F.exists(acc, lambda y: near(y.words, x.words)), acc).otherwise(F.concat(acc, F.array(x))))
    kept = F.when(F.size("all") > 1, F.transform(fold, lambda x: x.c)).otherwise(F.col("all"))
    return by.select("doc", "kind", "number", F.explode(kept).alias("c")).select("doc", "kind", "number", "c.caption", "c.start", "c.end", "c.confidence")


def _is_read() -> Column:
    return F.coalesce(F.col("inspected") & (F.trim(F.coalesce("read", F.lit(""))) != ""), F.lit(False))


def figures_at_once(roster: DataFrame, ledger: DataFrame, cited: DataFrame, shares: int | None = None) -> DataFrame:
    """One row per document and figure of any of the three, with what each says.

    ``roster``: doc, label, openable, tokens; ``ledger``: doc, label, inspected,
    read, note; ``cited``: doc, label, required, a row for each annotation that
    cites the figure.  Read means ticked and with a reading.  ``shares`` deals rows
    as ``dealt`` does.
    """
    roster, ledger, cited = (dealt(x, shares, "doc", "label") for x in (roster, ledger, cited))
    note = F.trim(F.coalesce("note", F.lit(""))) != ""
    r = roster.groupBy("doc", "label").agg(F.lit(True).alias("listed"), F.bool_or(F.coalesce("openable", F.lit(True))).alias("openable"), F.max("tokens").alias("tokens"))
    log = ledger.groupBy("doc", "label").agg(F.lit(True).alias("logged"), F.bool_or(_is_read()).alias("is_read"), F.bool_or(F.coalesce("inspected", F.lit(False))).alias("ticked"), F.bool_or(note).alias("noted"))
    c = cited.groupBy("doc", "label").agg(F.count(F.lit(1)).alias("n_cited"), F.count_if(F.coalesce("required", F.lit(False))).alias("n_required"))
    every = dealt(r.join(log, ["doc", "label"], "full"), shares, "doc", "label").join(c, ["doc", "label"], "full")
    return every.fillna(False, ["listed", "logged", "is_read", "ticked", "noted"]).fillna(True, ["openable"]).fillna(0, ["tokens", "n_cited", "n_required"])


def figure_audit(roster: DataFrame, ledger: DataFrame, cited: DataFrame, shares: int | None = None) -> DataFrame:
    """Per document (see ``figures_at_once``): figures missing in the ledger, unknown
    to the roster where there is one, read, ticked but not read, declined with a
    note, and annotations that need, or merely cite, a figure nobody read.
    Complete: there is a ledger, every tick has a reading, every need is met."""
    listed, logged, done, ticked, noted = (F.col(c) for c in ("listed", "logged", "is_read", "ticked", "noted"))
    n, has = F.count_if, F.bool_or("listed")
    left = lambda c: F.sum(F.when(~done, c).otherwise(0))
    out = dealt(figures_at_once(roster, ledger, cited, shares), shares, "doc").groupBy("doc").agg(
        F.when(has, n(listed)).otherwise(n(logged)).alias("total"), n(listed & ~logged).alias("missing"), F.when(has, n(logged & ~listed)).otherwise(F.lit(0)).alias("unknown"),
        n(done).alias("inspected"), n(ticked & ~done).alias("claimed_not_read"), n(logged & ~ticked & noted).alias("declined"), n(listed & ~F.col("openable")).alias("not_openable"),
        left(F.col("n_required")).alias("required_uninspected"), left(F.col("n_cited") - F.col("n_required")).alias("optional_uninspected"), F.bool_or(logged).alias("has_ledger"),
    )
    return out.withColumn("complete", F.col("has_ledger") & (F.col("required_uninspected") == 0) & (F.col("claimed_not_read") == 0))


def reading_plan(roster: DataFrame, ledger: DataFrame, cited: DataFrame, shares: int | None = None) -> DataFrame:
    """One row per figure that is cited or listed (see ``figures_at_once``), by its
    ``place`` in the document's order of labels, shorter ones first: whether it is
    needed, required, read, and what reading it costs."""
    every = dealt(figures_at_once(roster, ledger, cited, shares).where("n_cited > 0 or listed"), shares, "doc")
    place = F.row_number().over(W.partitionBy("doc").orderBy(F.length(F.col("label").cast("string")), "label"))
    state = F.when(F.col("n_cited") == 0, "not needed").when(F.col("is_read"), "read").when(F.col("n_required") > 0, "required").otherwise("pending")
    return every.select("doc", "label", place.alias("place"), "n_cited", state.alias("state"), "tokens")


def reading_costs(plan: DataFrame) -> DataFrame:
    """Tokens per document: of figures still to read, those required, those not needed."""
    of = lambda *states: F.sum(F.when(F.col("state").isin(*states), F.col("tokens")).otherwise(0))
    return plan.groupBy("doc").agg(of("pending", "required").alias("pending_tokens"), of("required").alias("required_tokens"), of("not needed").alias("not_needed_tokens"))


def section_text(text: Column, name: Column) -> Column:
    """A section's lines of more than three letters, blank lines between them, without
    what names the section at its head and without page marks."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("head"))

    def step(acc: Column, line: Column) -> Column:
        head = acc["head"] & ((line == "") | F.lower(line).contains(F.lower(name)))
        keep = ~head & (F.length(line) > 3) & ~line.startswith("--- PAGE")
        return F.struct(F.when(keep, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"), head.alias("head"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["kept"]), "\n\n")


def media_captions(media: DataFrame, found: DataFrame) -> DataFrame:
    """``media`` (doc, kind, number, ...) with the surest caption of its number, and
    captions of tables that no medium has, as rows of status uncovered."""
    sure = F.min(F.struct((-F.col("confidence")).alias("doubt"), "start", "caption"))
    best = found.groupBy("doc", "kind", "number").agg(sure.alias("c")).select("doc", "kind", "number", F.col("c.caption").alias("caption"))
    out = media.join(best, ["doc", "kind", "number"], "left").withColumn("status", F.when(F.col("caption").isNull(), "no caption").otherwise("captioned"))
    bare = best.where("kind = 'table'").join(media.select("doc", "kind", "number").distinct(), ["doc", "kind", "number"], "left_anti")
    return out.unionByName(bare.withColumn("status", F.lit("uncovered")), allowMissingColumns=True)


def conversion_quality(media: DataFrame, found: DataFrame, sections: DataFrame, sure: float = 0.8, least: int = 100) -> DataFrame:
    """Per document: media, those with captions, table captions without a medium, sure
    captions, sections, and those of more than ``least`` letters (start, end)."""
    m = media_captions(media, found).groupBy("doc").agg(F.count_if(F.col("status") != "uncovered").alias("n_media"), F.count_if(F.col("status") == "captioned").alias("n_captioned"), F.count_if(F.col("status") == "uncovered").alias("n_uncovered"))
    c = found.groupBy("doc").agg(F.count_if(F.col("confidence") > sure).alias("n_sure"))
    s = sections.groupBy("doc").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("end") - F.col("start") > least).alias("n_with_content"))
    out = m.join(c, "doc", "full").join(s, "doc", "full")
    return out.fillna(0, [x for x in out.columns if x != "doc"])


def nearest_captions(images: DataFrame, captions_: DataFrame, slack: float = 5.0, reach: float = 220.0, least_px: int = 50) -> DataFrame:
    """Each image box (doc, image, ...) with the nearest caption on the side where its
    kind stands: a figure's below, a table's above, within ``reach`` points on its
    page; status is captioned, no caption, or small (not looked at)."""
    large = (F.col("width") >= least_px) & (F.col("height") >= least_px)
    both = images.where(large).join(captions_, ["doc", "page"])
    below, above = F.col("caption_top") - F.col("bottom"), F.col("top") - F.col("caption_bottom")
    gap = F.when(F.col("kind") == "table", above).otherwise(below)
    near = both.withColumn("gap", gap).where((F.col("gap") >= -slack) & (F.col("gap") <= reach))
    place = F.row_number().over(W.partitionBy("doc", "image").orderBy("gap", "number", "kind"))
    best = near.withColumn("_n", place).where("_n = 1").select("doc", "image", "kind", "number", "gap")
    status = F.when(F.col("kind").isNotNull(), "captioned").when(large, "no caption").otherwise("small")
    return images.join(best, ["doc", "image"], "left").select("doc", "image", "kind", "number", "gap", status.alias("status"))


def unique_names(names: DataFrame) -> DataFrame:
    """``names`` (doc, seq, base) with name: base, then base with b to z, then with
    -2, -3, and so on."""
    n = F.row_number().over(W.partitionBy("doc", "base").orderBy("seq"))
    return names.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col("base")).when(F.col("_n") <= 26, F.concat("base", F.char(F.lit(96) + F.col("_n")))).otherwise(F.concat("base", F.lit("-"), (F.col("_n") - 25).cast("string")))).drop("_n")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")


def graphics_audit(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (doc, href) with the number of files (doc, path) of their stem."""
    have = files.groupBy("doc", stem(F.col("path")).alias("stem")).agg(F.count(F.lit(1)).alias("n_files"))
    return references.withColumn("stem", stem(F.col("href"))).join(have, ["doc", "stem"], "left").fillna(0, ["n_files"])


def interaction_entries(text: Column) -> Column:
    """Bullets with text, no {{placeholder}}, below headings that name interactions;
    a fold over a note's lines within its row."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, line: Column) -> Column:
        heading = line.rlike(r"^#{1,6}\s")
        entry = line.rlike(r"^\s*[-*]\s+\S") & ~line.rlike(r"^\s*[-*]\s+\{\{.*\}\}\s*$")
        inside = F.when(heading, line.rlike(r"(?i)^#{1,6}\s+.*interaction")).otherwise(acc.inside)
        return F.struct(inside.alias("inside"), (acc.n + F.when(~heading & acc.inside & entry, 1).otherwise(0)).cast("long").alias("n"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), r"\R"), start, step, lambda acc: acc.n)


def completion_counts(notes: DataFrame) -> DataFrame:
    """``notes`` (text) with the distinct accessions, locus tags and terms that stand
    in them, proteins (accessions and tags) and interactions; 0 for a null text."""
    text = F.coalesce("text", F.lit(""))
    ids = F.array_distinct(F.transform(extract_ids(text), F.upper))
    accessions = F.array_distinct(F.transform(F.filter(ids, lambda x: x.startswith("UNIPROT")), lambda x: F.substring_index(x, ":", -1)))
    n = lambda c: F.size(c).cast("long")
    out = notes.withColumns({"accessions": n(accessions), "locus_tags": n(locus_tags(text)), "terms": n(F.filter(ids, lambda x: ~x.startswith("UNIPROT"))), "interactions": interaction_entries(F.col("text"))})
    return out.withColumn("proteins", F.col("accessions") + F.col("locus_tags"))
