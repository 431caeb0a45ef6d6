"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def truthy(c: Column) -> Column:
    return F.lower(text_or_empty(c)).isin("true", "yes", "1")


def tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0))


def normal_phrase(c: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " "))


def normal_pmid(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?i)^pmid:\s*", "")


def locus_tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b[A-Z]{2,6}_\d{4,6}\b"), 0))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def table_cell(c: Column) -> Column:
    """Safe within a cell of a pipe table: one line, pipes escaped."""
    return strip(F.regexp_replace(F.regexp_replace(text_or_empty(c), r"\|", r"\\|"), r"(?U)\s+", " "))


def term_cell(term_id: Column, name: Column) -> Column:
    """A term's name and id; one without id is marked as unresolved."""
    known, said = text_or_empty(term_id), text_or_empty(name)
    named = F.when(said != "", F.concat(said, F.lit(" — "), known)).otherwise(known)
    return table_cell(F.when(known != "", named).otherwise(F.concat(F.lit("⚠ "), F.coalesce(F.nullif(said, F.lit("")), F.lit("(unresolved)")))))


def lenient_int(c: Column) -> Column:
    return F.coalesce(strip(c).try_cast("int"), F.lit(0))


def percent(c: Column) -> Column:
    """Whole percent of a share, half to even; null shows as a dash."""
    return F.coalesce(F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit("–"))


def name_stem(c: Column) -> Column:
    """Lower case, without a deletion mark, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "δ|∆|delta", ""), r"(?U)[^\p{Alnum}]", "")


def allele_stem(c: Column) -> Column:
    """The stem of what stands outside of brackets, however deep they are nested; a
    closing one too many is left out, after an opening one too many nothing counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(acc: Column, x: Column) -> Column:
        opens, closes = x.isin("(", "["), x.isin(")", "]")
        depth = F.when(opens, acc.depth + 1).when(closes, F.greatest(acc.depth - 1, F.lit(0))).otherwise(acc.depth)
        return F.struct(F.when(opens | closes | (acc.depth > 0), acc.out).otherwise(F.concat(acc.out, x)).alias("out"), depth.alias("depth"))

    return name_stem(F.aggregate(F.split(F.coalesce(c, F.lit("")), ""), start, step, lambda acc: acc.out))


def named_by_allele(name: Column, alleles: Column) -> Column:
    """Whether a genotype's name holds the stem of one of its alleles, with or
    without what that has in brackets; null without a name or alleles."""
    held = F.filter(F.transform(F.coalesce(alleles, F.array().cast("array<string>")), text_or_empty), lambda a: a != "")
    stems = F.filter(F.concat(F.transform(held, allele_stem), F.transform(held, name_stem)), lambda s: s != "")
    return F.when((text_or_empty(name) != "") & (F.size(stems) > 0), F.exists(stems, lambda s: name_stem(name).contains(s)))


def word_jaccard(a: Column, b: Column) -> Column:
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    x, y = split(a), split(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


_CITED = r"(?i)\bfig(?:ure)?s?\.?\s*(\d+)"


def figure_labels(c: Column) -> Column:
    """Distinct figures that a text cites, in order, as 'Figure n'."""
    numbers = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_CITED), 1))
    return F.transform(numbers, lambda n: F.concat(F.lit("Figure "), n))


def figure_label(c: Column) -> Column:
    """'Fig 5A', 'figure 5' and '5' as 'Figure 5'; what names no number as it is."""
    said = text_or_empty(c)
    number = F.coalesce(F.nullif(F.regexp_extract(said, _CITED, 1), F.lit("")), F.nullif(F.regexp_extract(said, r"^(\d+)", 1), F.lit("")))
    return F.coalesce(F.concat(F.lit("Figure "), number), said)


#: Pixels a token stands for, and what pictures are scaled down to.
PIXELS_PER_TOKEN, LONGEST_EDGE, MOST_PIXELS = 750, 1568, 1_150_000


def image_tokens(width: Column, height: Column) -> Column:
    area = (width * height).cast("double")
    scale = F.least(F.lit(1.0), F.lit(float(LONGEST_EDGE)) / F.greatest(width, height), F.sqrt(F.lit(float(MOST_PIXELS)) / area))
    return F.when((width > 0) & (height > 0), F.bround(width * scale * (height * scale) / PIXELS_PER_TOKEN, 0)).otherwise(0).cast("long")


def extensions_text(c: Column, without: tuple[str, ...] = ()) -> Column:
    """relation=value pairs of an array of structs, but those of some relations."""
    relation = lambda e: text_or_empty(e.relation)
    shown = F.filter(c, lambda e: (relation(e) != "") & ~relation(e).isin(*without) if without else relation(e) != "")
    return F.coalesce(F.array_join(F.transform(shown, lambda e: F.concat(relation(e), F.lit("="), text_or_empty(e.value))), " · "), F.lit(""))


def extension_values(c: Column, relation: str) -> Column:
    """The values of one relation."""
    held = F.filter(c, lambda e: text_or_empty(e.relation) == relation)
    return F.coalesce(F.array_join(F.transform(held, lambda e: text_or_empty(e.value)), "; "), F.lit(""))


def stamp(tool: str, model: Column, date: Column, revision: Column | None = None, today: Column | None = None) -> Column:
    """What made an output, of which revision, on which day; missing parts are left
    out, and without a date ``today`` stands."""
    said = [F.concat_ws(" · ", F.lit(tool), F.nullif(text_or_empty(model), F.lit("")))]
    if revision is not None:
        said.append(F.concat(F.lit("commit "), F.nullif(text_or_empty(revision), F.lit(""))))
    day = F.coalesce(F.nullif(text_or_empty(date), F.lit("")), (F.current_date() if today is None else today).cast("string"))
    return F.concat_ws(" · ", *said, F.concat(F.lit("date "), day))


def thousands(c: Column) -> Column:
    """A whole number with commas between thousands; null shows as a dash."""
    return F.coalesce(F.format_number(c.cast("long"), 0), F.lit("–"))


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` letters, the last an ellipsis if some are missing."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def citation(author: Column, year: Column, fallback: Column) -> Column:
    """First author's last word and year, or what else there is."""
    first = F.regexp_extract(text_or_empty(author), r"^[^\s,;]+", 0)
    both = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(text_or_empty(year), F.lit("")))
    return F.coalesce(F.nullif(both, F.lit("")), fallback)
