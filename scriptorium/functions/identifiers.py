"""Identifiers in text: extraction and format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scriptorium.functions.text import strip

# Digits of a local id by prefix, the accession pattern, spellings of its prefix.
DIGITS = {"PHIPO": 7, "PHIPO_EXT": 7, "GO": 7, "PHIDO": 7, "MOD": 5, "BTO": 7, "PECO": 7, "FYPO_EXT": 7, "PomGeneEx": 7}
ACCESSION = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:-\d+)?$"
ACCESSION_PREFIX = "UniProtKB"
IN_TEXT = r"(?i)\b(?:PHIPO_EXT|PHIPO|FYPO_EXT|PHIDO|GO|MOD|BTO|PECO|PomGeneEx|UniProtKB|UniProt):[A-Za-z0-9-]+"
ASSERTED = r"\b(?:PHIPO|GO|PHIDO|FYPO|PECO|UniProtKB|UniProt):[A-Za-z0-9]+\b"


def extract_ids(c: Column) -> Column:
    """Every identifier of a known prefix, first occurrences, as written."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(IN_TEXT), 0))


def asserted_ids(c: Column) -> Column:
    """Identifiers that a document asserts, normalised; emphasis marks are ignored."""
    found = F.regexp_extract_all(F.regexp_replace(c, "[*`]+", ""), F.lit(ASSERTED), 0)
    space = lambda x: F.when(F.lower(x).startswith("uniprot"), F.lit(ACCESSION_PREFIX)).otherwise(F.upper(F.substring_index(x, ":", 1)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(space(x), F.lit(":"), F.upper(F.substring_index(x, ":", -1))))))


def canonical_prefix(c: Column) -> Column:
    """The prefix as it is officially written; null if it is not a known one."""
    given = F.upper(F.substring_index(strip(c), ":", 1))
    known = F.create_map(*[F.lit(x) for k in DIGITS for x in (k.upper(), k)], F.lit("UNIPROTKB"), F.lit(ACCESSION_PREFIX), F.lit("UNIPROT"), F.lit(ACCESSION_PREFIX))
    return F.when(c.contains(":"), F.try_element_at(known, given))


def local_part(c: Column) -> Column:
    return strip(F.regexp_extract(strip(c), "(?s)^[^:]*:(.*)$", 1))


def format_valid(c: Column) -> Column:
    """Whether the local part has its prefix's official form."""
    prefix, local = canonical_prefix(c), local_part(c)
    by_digits = F.create_map(*[F.lit(x) for k, n in DIGITS.items() for x in (k, n)])
    digits = F.try_element_at(by_digits, prefix)
    return F.coalesce(F.when(prefix == ACCESSION_PREFIX, local.rlike(ACCESSION)).otherwise(local.rlike("^[0-9]+$") & (F.length(local) == digits)), F.lit(False))
