"""Fill-in-the-middle: a document's lines are cut into prefix, middle and
suffix, and put in the order in which a model learns to write the middle.

Each batch runs through ``pyarrow.compute`` as a whole: texts are split into
lists of units, the lists flattened next to the index of their parent, units
numbered within the parent, filtered by the role that their number gives them,
gathered into lists again and joined.  Only the cuts' hashes come from outside,
as Spark columns, so a document is cut alike wherever it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import slices

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
FACTS = "n long, form string, prefix_chars long, middle_chars long"


def hashes(doc_id: Column, salt: str = "7") -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``salt:doc_id``; a null
    doc_id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of all texts, each with its line break, flat; the index of each
    one's text; and the number of lines of each text.  An empty text has none."""
    pieces = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    last = np.ones(len(flat), bool)
    last[:-1] = parent[1:] != parent[:-1]
    units = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n"), "")
    there = pc.not_equal(units, "")  # the piece after a final line break is none
    parent = parent[there.to_numpy(zero_copy_only=False)]
    return units.filter(there), parent, np.bincount(parent, minlength=len(texts)).astype(np.int64)


def ordinals(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """The chosen units of each of ``n`` texts, joined."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(parent[chosen], minlength=n))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), units.filter(pa.array(chosen))), "")


def restore(output: pa.Array, form: pa.Array, marks: tuple[str, str, str] = MARKS) -> pa.Array:
    """The texts that outputs were made of."""
    plain = pc.equal(form, "plain")
    parts = pc.split_pattern_regex(pc.if_else(plain, "".join(marks), output), "|".join(marks), max_splits=3)
    one, two, middle = (pc.list_element(parts, k) for k in (1, 2, 3))
    psm = pc.equal(form, "psm")
    whole = pc.binary_join_element_wise(pc.if_else(psm, one, two), middle, pc.if_else(psm, two, one), "")
    return pc.if_else(plain, output, whole)


def transform(batch: pa.RecordBatch, rate: int, spm: int, marks: tuple[str, str, str]) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
    units, parent, n = units_of(texts)
    cuts = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
    place = ordinals(n)
    role = (place >= cuts[0][parent]).astype(np.int8) + (place >= cuts[1][parent])
    prefix, middle, suffix = (joined(units, parent, role == k, len(texts)) for k in range(3))

    plain = pc.equal(texts, "")
    for mark in marks:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    plain = pc.or_(plain, pa.array(h[2] % 100 >= rate))
    form = pc.if_else(plain, "plain", pc.if_else(pa.array(h[3] % 100 < spm), "spm", "psm"))
    p, s, m = marks
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    turned = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), turned, psm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(c).cast(pa.int64())) for c in (prefix, middle)]
    return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), form, *chars, output, restore(output, form, marks)], names=["key", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])


def fill_in_middle(docs: DataFrame, salt: str = "7", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored), one row per
    input row; no row moves between tasks.

    ``rate`` percent of the documents are transformed and ``spm`` percent of those
    put the suffix first; the others, empty texts, and texts that hold a mark are
    plain: their output is the text.  ``restored`` is rebuilt from output and form
    alone.  Null counts as the empty text, a null doc_id as an empty one; repeated
    rows get a row each, equal ones equal results (there are no ties to break); a
    very long text is a slice of its own, held a few times over in one task; an
    empty table gives none; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield transform(part, rate, spm, marks)

    cut = docs.select(F.col("doc_id").alias("key"), "text", *[h.alias(f"h{k}") for k, h in enumerate(hashes(F.col("doc_id"), salt), 1)])
    return cut.mapInArrow(run, f"key {kind}, {FACTS}, output string, restored string").withColumnRenamed("key", "doc_id")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
num AS (
  SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS b,
         ('0x' || h[25:32])::BIGINT % 100 AS turn FROM cut),
parts AS (
  SELECT *, array_to_string(l[1:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(l[greatest(a, b) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN turn < 50 THEN 'spm' ELSE 'psm' END AS form FROM num)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
