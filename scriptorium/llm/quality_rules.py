"""Quality rules: base counts, and compression bands.

A text that repeats itself compresses far better than prose of its length, and
keys, encoded blobs or noise far worse.  Each whole document is compressed with
zstandard, and so is each full chunk of fixed size; the ratio (compressed bytes
over bytes) has to lie in a band that depends on the length, since short texts
compress less.  A document fails if its own ratio leaves its band, or if half
of its full chunks or more leave theirs.

Bands are learned where there are labels: for each length class they reach from
the lowest to the highest ratios that texts labelled good show, but for a stated
share at either end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import texts_of

#: (bytes below which the band holds, least ratio, greatest ratio), where nothing is
#: learned: wide enough for any prose.  The shortest class holds for all below its bound.
BANDS: tuple[tuple[float, float, float], ...] = (
    (128, 0.45, 1.60),
    (256, 0.40, 1.12),
    (512, 0.42, 0.95),
    (1024, 0.41, 0.85),
    (2048, 0.39, 0.78),
    (4096, 0.375, 0.74),
    (8192, 0.36, 0.72),
    (16384, 0.35, 0.70),
    (float("inf"), 0.335, 0.70),
)
LEVEL = 3
CHUNK = 4096

#: Bounds of length classes for learning, in bytes.
CLASSES = tuple(float(128 << k) for k in range(10)) + (float("inf"),)
#: Labelled rows that a class needs.
LEAST_ROWS = 40
#: Steps of a ratio of 1 that quantiles tell apart; they bound what a class's counts hold.
RATIO_STEPS = 100_000
#: The share of good texts below and above a band, and how much a band is widened.
TAIL, SLACK = 0.005, 0.015


class Bands(NamedTuple):
    texts: tuple[tuple[float, float, float], ...] = BANDS
    chunk: tuple[float, float] | None = None  # of full chunks; that of texts of their length if None

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"
)


def band(n_bytes: int, bands: Sequence[tuple[float, float, float]] = BANDS) -> tuple[float, float]:
    for limit, least, most in bands:
        if n_bytes < limit:
            return least, most
    return bands[-1][1:]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, each once."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1] * len(number) + ids[2:]
    _, window, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[window] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def dup_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def judge(text: str, compress=None, bands: Bands = Bands(), chunk: int = CHUNK) -> tuple:
    """The columns after doc_id, for one text."""
    compress = compress or zstandard.ZstdCompressor(level=LEVEL).compress
    data = text.encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    repeats = repeat_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    ratio = len(compress(data)) / len(data) if data else 0.0
    least, most = band(len(data), bands.texts)
    c_least, c_most = bands.chunk or band(chunk, bands.texts)
    n_chunks = len(data) // chunk if len(data) >= 2 * chunk else 0
    bad = 0
    for k in range(n_chunks):
        r = len(compress(data[k * chunk : (k + 1) * chunk])) / chunk
        bad += not c_least <= r <= c_most
    reason = (
        "base" if failed
        else "repetitive" if ratio < least
        else "incompressible" if ratio > most
        else "chunks" if n_chunks and 2 * bad >= n_chunks
        else ""
    )
    return len(words), len(text) - spaces, symbols, dup_lines(data), repeats, failed, not reason, ratio, n_chunks, bad, reason


def fit_bands(docs: DataFrame, labels: DataFrame, level: int = LEVEL, chunk: int = CHUNK) -> Bands:
    """Bands from texts that ``labels`` (doc_id, quality) calls good.

    Learned from every one of them whose crc32(doc_id as text) mod 3 is not 1, whole
    texts, compressed in executors; a ratio is counted to a part in RATIO_STEPS, so
    what is counted does not grow with the rows, and the quantiles are of all rows.
    Two numbers for each class come back.  A class of fewer than
    ``LEAST_ROWS`` keeps its band of ``BANDS``.  Nulls are no labels; of a document
    that is called both good and bad no row is taken; no labels, no change.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    known = known.where((F.col("q") == 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        for b in batches:
            out: list[tuple[int, int, float]] = []
            ids = b.column("doc_id").to_pylist()
            for i, text in texts_of(b):
                data = text.encode()
                words = data.split()
                if len(words) < 50 or 100 * repeat_words(words) > 50 * len(words):
                    continue
                out.append((ids[i], next(k for k, limit in enumerate(CLASSES) if len(data) < limit), len(compress(data)) / len(data)))
                if len(data) >= 2 * chunk:
                    out += [(ids[i], -1, len(compress(data[k : k + chunk])) / chunk) for k in range(0, len(data) - chunk + 1, chunk)]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], names=["doc_id", "class", "ratio"])

    # ratios of all that may be learned from, so that these and no texts meet the labels
    mine = docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = mine.mapInArrow(run, "doc_id long, class int, ratio double").join(known.select("doc_id"), "doc_id", "left_semi")
    counts = ratios.groupBy("class", (F.round(F.col("ratio") * RATIO_STEPS) / RATIO_STEPS).alias("ratio")).agg(F.count("*").alias("n"))
    found = {r[0]: r[1:] for r in counts.groupBy("class").agg(F.sum("n"), F.percentile("ratio", F.lit(TAIL), F.col("n")), F.percentile("ratio", F.lit(1 - TAIL), F.col("n"))).collect()}
    wide = {k: (least * (1 - SLACK), most * (1 + SLACK)) for k, (n, least, most) in found.items() if n >= LEAST_ROWS}
    return Bands(tuple((limit, *wide.get(k, band(limit - 1, BANDS))) for k, limit in enumerate(CLASSES)), wide.get(-1))


def compression_bands(docs: DataFrame, bands: Bands = Bands(), level: int = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: the base counts, the ratios, ``kept`` and the first
    rule that failed.  No shuffle; a text is held by one task at a time.

    A null or empty text has no words and fails the base rule; a null doc_id is
    kept as null; repeated rows are judged alike; a very long text is judged whole,
    chunk after chunk; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        for b in batches:
            rows = [judge(t, compress, bands, chunk) for _, t in texts_of(b)]
            cols = list(zip(*rows)) if rows else [[]] * 11
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], schema=None, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, whole, with their columns: the pipeline's
    filter.  Judged in the scan's own tasks, so nothing is shuffled or joined."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            good = pa.array([judge(t, compress, bands)[6] for _, t in texts_of(b)], pa.bool_())
            yield b.filter(good)

    return docs.select(*names).mapInArrow(run, docs.schema)


