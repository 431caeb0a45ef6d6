"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs, text runs and media references
alike; a reference carries its position, its caption and the digest it names.
Payloads live in a table of their own, keyed by digest, each stored losslessly
as 8-bit grey samples in a PNG.  Facts about a payload are computed from the
stored bytes once they are read back, and references meet them in an equi-join
on the digest, which moves digests and small facts, never payloads.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import materialize, slices, texts_of

#: Samples a row of the stored picture has, and the number payloads are padded to a multiple of.
WIDTH = 192

SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style template noscript".split())
_MEDIA = frozenset("img video audio".split())
_BREAKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br ul ol table section article figure blockquote pre".split())
_DIGEST = re.compile(r"(?i)sha256[:/-]([0-9a-f]{64})")
_PNG = b"\x89PNG\r\n\x1a\n"


class _Sequence(HTMLParser):
    """Text runs and references in document order.  A caption belongs to every
    reference of its own figure; without one, the alternative text is taken."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[tuple[int, list[str]]] = []
        self.caption = 0

    def close_run(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BREAKS or tag in _MEDIA:
            self.close_run()
        if tag == "figure":
            self.figures.append((len(self.items), []))
        elif tag == "figcaption":
            self.close_run()
            self.caption += 1
        elif tag in _MEDIA:
            have = dict(attrs)
            src = have.get("src") or have.get("data-src") or ""
            found = _DIGEST.search(src)
            self.items.append([tag, None, found[1].lower() if found else src, have.get("alt") or None])

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption":
            self.caption = max(0, self.caption - 1)
        elif tag == "figure" and self.figures:
            self.close_run()
            first, said = self.figures.pop()
            caption = " ".join("".join(said).split())
            if caption:
                for item in self.items[first:]:
                    if item[0] != "text":
                        item[3] = caption
        elif tag in _BREAKS:
            self.close_run()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.caption and self.figures:
            self.figures[-1][1].append(data)
        else:
            self.run.append(data)


def sequence_of(html: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.close_run()
    return [dict(pos=i, kind=k, text=t, ref=r, caption=c) for i, (k, t, r, c) in enumerate(parser.items)]


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): each page's text runs and media references in order.  Null
    or empty HTML has no items; broken markup never fails."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence_of(t) for _, t in texts_of(b, "html")], pa.list_(item))], names=["key", "items"])

    out = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, items {SEQUENCE}")
    return out.withColumnRenamed("key", key)


def resolve(items: DataFrame, key: str, media: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per item with its payload's facts, and the columns that ``carry``
    names: ``media`` has one row per digest.  A reference that no payload answers
    stays, with resolved false."""
    flat = items.select(key, *carry, F.explode_outer("items").alias("i")).select(key, *carry, "i.*")
    # items without a reference would all meet in one task; a key of their own, which
    # is no digest, deals them over all
    at = F.coalesce("ref", F.concat_ws(":", F.lit("none"), F.col(key).cast("string"), "pos"))
    seen = media.withColumnRenamed("digest", "_at").withColumn("_there", F.lit(True))
    found = flat.withColumn("_at", at).join(seen, "_at", "left").withColumn("resolved", F.coalesce("_there", F.lit(False)))
    return found.select("ref", *[c for c in found.columns if c not in ("ref", "_at", "_there")])


def encode_payload(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit greyscale PNG of ``width`` samples a row, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


def decode_payload(stored: bytes) -> np.ndarray:
    """The samples of such a PNG, checked against its checksums."""
    if stored[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += n + 12
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(lines[:, 1:])


def feature_of(samples: np.ndarray) -> str:
    """A difference hash: mean samples of a 9 x 8 grid, one bit for each pair of
    neighbours that rises, as 16 hexadecimal digits; then the overall mean."""
    rows = np.array_split(np.arange(len(samples)), 8)
    cols = np.array_split(np.arange(samples.shape[1]), 9)
    by_col = np.add.reduceat(samples.astype(np.int64), [c[0] for c in cols], axis=1)
    total = np.cumsum(np.concatenate([np.zeros((1, 9), np.int64), by_col]), axis=0)
    grid = np.array([(total[r[-1] + 1] - total[r[0]]) / len(r) if len(r) else np.zeros(9) for r in rows]) / [len(c) for c in cols]
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    return f"{int.from_bytes(np.packbits(bits).tobytes()):016x}-{samples.mean():.3f}"


def digest_of(text: Column) -> Column:
    """The digest that a reference to a text's payload names."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256)


def store_payloads(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(digest, n_bytes, media): every text as UTF-8, padded with spaces to a
    positive multiple of ``width``, stored losslessly; written to the shared
    folder and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):  # so that few payloads are held at once
                digests, sizes, stored = [], [], []
                for _, text in texts_of(part):
                    data = text.encode()
                    digests.append(hashlib.sha256(data).hexdigest())
                    sizes.append(len(data))
                    stored.append(encode_payload(data.ljust(max(width, -(-len(data) // width) * width), b" "), width))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], names=["digest", "n_bytes", "media"])

    # the stored form is compressed already
    return materialize(docs.select("text").mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


def payload_facts(media: DataFrame) -> DataFrame:
    """One row per digest: what its stored bytes hold.  Equal payloads have equal
    facts, so of repeated digests any row serves, and the sums combine map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stored in b.column("media"):
                data = stored.as_py()
                samples = decode_payload(data)
                back = samples.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["digest", "n_bytes", *FACTS])

    facts = media.mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return facts.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("n_bytes", *FACTS)])


FACTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def figure_of(text: Column, caption: Column) -> Column:
    """A figure whose picture is the text's payload; the caption is HTML already."""
    return F.concat(F.lit("<figure><img src='media://sha256/"), digest_of(text), F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))


def as_html(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def document_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page that holds its whole text: a figure whose picture is
    the document's payload and whose caption is its first line, then a paragraph for
    each further line."""
    first = F.substring_index("said", "\n", 1)
    rest = F.replace(F.substring(F.col("said"), F.length(first) + 2, F.length("said")), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<article>"), figure_of(F.col("text"), first), F.lit("<p>"), rest, F.lit("</p></article>"))
    return docs.select("doc_id", "text", as_html(F.col("text")).alias("said")).select("doc_id", html.alias("html"))


def document_figures(docs: DataFrame) -> DataFrame:
    """The figure that stands for a document in a page that does not hold its text:
    the caption is the start of its first line, 80 letters at most."""
    start = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]{0,80}", 0)
    return docs.select("doc_id", F.concat(F.lit("<article>"), figure_of(F.col("text"), as_html(start)), F.lit("</article>")).alias("html"))


def page_media(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Items of whole pages, text runs and references in their order, with the
    facts of the payloads that references name: (page_id, pos, kind, text, ref,
    caption, resolved and FACTS).

    A page's HTML is followed by a figure for the document whose doc_id is its
    page_id, captioned with the start of that document (``document_figures``; the
    whole of it is the payload, and a page of its own in ``document_pages``); a page without such a
    document has none.  Null or empty HTML has no items of its own; repeated pages
    have their items each; of documents that share a doc_id the least figure
    counts; a very long page is parsed whole, by itself; items are in page order, so
    there are no ties; empty tables give nothing; other columns are ignored.
    """
    figures = document_figures(docs.where("doc_id is not null").select("doc_id", "text")).groupBy("doc_id").agg(F.min("html").alias("figure"))
    own = pages.select("page_id", "html").join(figures.withColumnRenamed("doc_id", "page_id"), "page_id", "left")
    whole = own.select("page_id", F.concat(F.coalesce("html", F.lit("")), F.coalesce("figure", F.lit(""))).alias("html"))
    return resolve(interleave(whole), "page_id", payload_facts(store_payloads(docs))).where("pos is not null")


#: What tells of a document's whole sequence.
WHOLE = ("n_items", "n_text_chars", "sequence_sha256")


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per input row: what the payload of its text holds once stored and
    read back, with the position and caption of the reference that led to it, and of
    the whole interleaved sequence (``interleave(document_pages(docs), "doc_id")``) the
    number of items, the letters of its text runs, and the SHA-256 of its items in
    order: kind, text, ref and caption, tab-joined, a line each, null as empty.

    Null counts as the empty text, whose payload is spaces; a null doc_id stays
    null; repeated rows get a row each; a text of any length is stored whole, a
    very long one by itself; an empty table gives none; other columns are ignored.
    """
    facts = payload_facts(store_payloads(docs))
    pages = interleave(document_pages(docs), "doc_id")
    empty = lambda c: F.coalesce(c, F.lit(""))
    lines = F.transform("items", lambda i: F.concat_ws("\t", i.kind, empty(i.text), empty(i.ref), empty(i.caption)))
    letters = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.length(empty(i.text)))
    # text runs have no payload to meet, so only references go to the join
    found = pages.select("doc_id", F.filter("items", lambda i: i.kind != "text").alias("items"), *(c.alias(n) for c, n in zip((F.size("items").cast("long"), letters, F.sha2(F.concat_ws("\n", lines), 256)), WHOLE)))
    return resolve(found, "doc_id", facts, WHOLE)
