"""The pipeline's stages in turn, against brute-force versions."""

import hashlib
import random
from collections import Counter

import numpy as np

import corpus_pipeline
from scriptorium.llm import quality_rules
from tests.llm.test_operators import SCHEMA, WORD, brute_near, brute_suffix, brute_targets, prose, rows_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, folder):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        yield name, before.select(*COLUMNS), docs


def no_labels(spark, folder):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def made(spark, folder):
    rng = random.Random(8)
    rows = rows_of(7)
    base = prose(rng, 150).split(" ")
    rows += [(500 + k, prose(rng, 120), "s9", "en", 1, 2, 0.5, "z", "q") for k in range(20)]
    rows += [(600 + k, " ".join([*base[:140], *prose(rng, 4).split(" "), *base[144:]]), "s1", "en", 1, 2, 0.5, "z", "q") for k in range(6)]
    rows += [(700, rows[-1][1], "s1", "en", 1, 2, 0.5, "z", "q"), (None, prose(rng, 90), "s2", "en", 1, 2, 0.5, "z", "q")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "lang", "source", "length(text) n_chars", "size", "n_words", "kept", "copied", "1 sequence_id", "'x' digest")
    docs.write.parquet(f"{folder}/documents.parquet")
    no_labels(spark, folder)
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, tmp_path):
    docs = made(spark, tmp_path)
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.text or "")
    for name, before, after in stages(spark, docs, str(tmp_path)):
        old = sorted(before.collect(), key=key)
        if name == "packing":
            break
        assert after.columns == COLUMNS
        new = sorted(after.collect(), key=key)
        if name == "quality rules":
            judged = {r.text: quality_rules.judge(r.text or "")[-1] for r in old}
            assert new == [r for r in old if not judged[r.text]]
            assert sum(500 <= (r.doc_id or 0) < 520 for r in new) == 20  # clean prose stays
        elif name == "near duplicates":
            root = brute_near([(r.doc_id, r.text) for r in old], 5, 80)
            assert new == [r for r in old if r.doc_id is None or root[r.doc_id][1] == r.doc_id]
            assert [r.doc_id for r in new if 600 <= (r.doc_id or 0) <= 700] == [600]
        elif name == "suffix-array dedup":
            want = brute_suffix([(r.doc_id, r.text) for r in old])
            left = {r.doc_id: r.text for r in new if r.doc_id is not None}
            for r in old:
                if r.doc_id is not None:
                    n, removed, _, kept = want[r.doc_id]
                    if not removed:
                        assert left[r.doc_id] == r.text
                    elif r.doc_id in left and r.text.isascii():
                        assert hashlib.sha256(left[r.doc_id].encode()).hexdigest() == kept
        elif name == "mixing":
            size, took = Counter(), Counter()
            for r in old:
                size[r.source] += len(WORD.findall(r.text))
            copies = Counter((r.doc_id, r.text, r.source) for r in new)
            assert set(copies) <= {(r.doc_id, r.text, r.source) for r in old}
            most = Counter((r.doc_id, r.text, r.source) for r in old)
            assert all(n <= 3 * most[k] for k, n in copies.items())
            for (_, text, source), n in copies.items():
                took[source] += n * len(WORD.findall(text))
            # each source is taken to its target; the last document of a shard comes whole, with rows that repeat it
            last = max(n * len(WORD.findall(k[1])) for k, n in most.items())
            for s, t in brute_targets(size).items():
                assert t - 2 <= took[s] <= t + last + 2
        assert any(r.doc_id is None for r in new)
    packed = after.toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert len(np.unique(packed[packed.piece == 0].index)) == len(old)  # one first piece for each row
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    no_labels(spark, tmp_path)
    for _, _, after in stages(spark, docs, str(tmp_path)):
        assert after.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
