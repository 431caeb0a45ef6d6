"""Texts above a mebibyte, ties, repeated rows and clashing columns, for the operators
over documents: each against what a plain reading of the text gives."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import media, mixing, near_dup, packing, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filter
from scriptorium.llm.queries import BYTE_BPE, WORD_BPE
from tests.llm.test_operators import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that clash with results and with names that operators use inside.
CLASH = "doc_id long, text string, source string, size long, n_bytes long, kept string, class_id long, shard int, sequence_id long, digest string, n int, d string, u string, p string"


@pytest.fixture(scope="module")
def made():
    rng = random.Random(12)
    long = prose(rng, 190_000)
    words = long.split(" ")
    near = " ".join(words[:100_000] + ["changed"] + words[100_001:])
    passage = " ".join(words[50:150])
    texts = [long, near, "x" * 1_300_000, "\n".join(["same line of a text"] * 60_000), prose(rng, 120) + " " + passage + " " + prose(rng, 120), "", None, long]
    rows = [(k, t, "s", 1, 2, "k", 3, 4, 5, "g", 6, "d", "u", "p") for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[4]]


@pytest.fixture(scope="module")
def docs(spark, made):
    frame = spark.createDataFrame(made, CLASH).repartition(3).cache()
    assert max(len((r[1] or "").encode()) for r in made) > 1 << 20
    return frame


def test_mixing(docs, made):
    got = mixing.mix_sources(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in made)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_token_counts(docs, made):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    want = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in made}
    got = token_counts.token_counts(docs, WORD_BPE).collect()
    assert len(got) == len(made)
    assert all(r.n_tokens == want[r.doc_id] and r.over_limit == (want[r.doc_id] > 2048) for r in got)


def test_suffix_dedup(docs, made):
    """The copy goes whole, the near copy but for what holds the changed word."""
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs, length=50).collect()}
    text = {r[0]: (r[1] or "").encode() for r in made}
    assert (got[0].n_removed, got[7].n_removed, got[5].n_removed, got[6].n_bytes) == (0, len(text[7]), 0, 0)
    assert bytes(got[2].kept) == text[2]
    earlier = {text[0][k : k + 50] for k in range(len(text[0]) - 49)}
    for doc in (1, 4):
        gone = bytearray(len(text[doc]))
        for k in range(len(text[doc]) - 49):
            if text[doc][k : k + 50] in earlier:
                gone[k : k + 50] = b"\1" * 50
        assert got[doc].n_removed == sum(gone)
        assert bytes(got[doc].kept) == bytes(b for b, g in zip(text[doc], gone) if not g)


def test_near_duplicates(docs, made):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, words=2, percent=80).collect()}
    assert {k: r.component_id for k, r in got.items()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 0}
    words = WORD.findall(made[0][1])
    assert got[0].n_shingles == len(set(zip(words, words[1:]))) and got[2].n_shingles == 1 and got[3].n_shingles == 5 and got[5].n_shingles == 0


def test_shared_passages(docs, made):
    got = {r.doc_id: r for r in substring_dedup.shared_passages(docs).collect()}
    assert got[0].class_id == got[7].class_id == 0 and got[1].n_links >= 1 and got[4].n_links >= 1
    assert got[4].n_shared_words >= 90 and got[2].n_links == got[5].n_links == 0


def test_packing(docs, made):
    got = packing.best_fit_pack(docs, BYTE_BPE).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    want = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in made if r[0] != 3}
    times = {k: [r[0] for r in made].count(k) for k in want}
    assert got.groupby("doc_id")["length"].sum()[list(want)].to_dict() == {k: n * times[k] for k, n in want.items()}
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024
    ends = got.sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id")["length"].cumsum() - ends["length"] == ends["offset"]).all()


def test_media(docs, made):
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for k, text, *_ in made:
        data = (text or "").encode()
        padded = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_page_media(spark, docs):
    fields = "page_id long, url string, html string, text string, pos int, kind string, ref string"
    page = "<p>a</p><img src='x' alt='y'>" * 50_000
    rows = [(0, None, page, "t", 1, "k", "r"), (0, None, page, "t", 1, "k", "r"), (900, None, None, "t", 1, "k", "r"), (None, "u", "<p>b", "t", 1, "k", "r")]
    got = media.page_media(spark.createDataFrame(rows, fields), docs)
    count = {r.page_id: r["count"] for r in got.groupBy("page_id").count().collect()}
    assert count == {0: 2 * 100_001, None: 1}
    empty = spark.createDataFrame([], fields)
    assert media.page_media(empty, docs).collect() == [] and media.page_media(empty, docs.limit(0)).collect() == []


def test_quality_rules(docs, made):
    got = {r.doc_id: r for r in quality_rules.compression_bands(docs).collect()}
    for k, text, *_ in made:
        words = WORD.findall(text or "")
        assert (got[k].n_words, got[k].word_chars) == (len(words), sum(map(len, words)))
    assert got[0].kept and not got[3].kept and got[3].n_dup_lines == 59_999 and got[3].n_repeat_words == got[3].n_words


def test_long_urls(spark):
    deep = "http://User:pw@Bad.example:80/" + "a/" * 400_000 + "?q=" + "z" * 200_000
    rows = [(1, deep, "x", "y", 3), (1, deep, "x", "y", 3), (2, "http://good.example/" + "b" * 1_200_000, "x", "y", 3), (3, None, "x", "y", 3)]
    fields = "page_id long, url string, matched_pattern string, pattern string, n_matches int"
    captures = spark.createDataFrame(rows, fields).withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    entries = spark.createDataFrame([("bad.example", "2024-01-01", "add"), ("good.example/b", "2024-01-01", "add"), ("bad.example/a", "2024-01-01", "add")], "pattern string, effective_at string, action string")
    entries = entries.withColumn("effective_at", F.col("effective_at").cast("timestamp"))
    got = sorted((r.page_id, r.blocked, r.matched_pattern) for r in url_filter.evaluate(captures, entries).collect())
    assert got == [(1, True, "bad.example/a"), (1, True, "bad.example/a"), (2, False, None), (3, False, None)]
