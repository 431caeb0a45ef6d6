"""Streams over several batches: keyed tables, the ranking, first-seen intake, late rows, parking."""

import json
import os
import random
from datetime import datetime

from pyspark.sql import functions as F

from scriptorium.operators import drafts, ledger
from scriptorium.sources.readers import CANTO, GAP_EVENT
from scriptorium.streaming import jobs
from scriptorium.streaming.keyed import KeyedTable
from scriptorium.streaming.ranking import GapRanking


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_keyed_table(spark, tmp_path):
    """Every batch writes its changes, a replay changes nothing, merged runs go."""
    rng, now = random.Random(1), {}
    schema = spark.createDataFrame([], "a string, b long, seq long, said string").schema
    table = KeyedTable(spark, str(tmp_path), schema, ["a", "b"], "seq", by=["a"], buckets=4, fan=3)
    big = [(f"k{k}", k, k, "x" * 200) for k in range(3000)]
    for epoch in range(11):
        rows = big if epoch == 0 else [(rng.choice(["k1", "k2", None, f"n{epoch}"]), rng.randint(0, 3), rng.randint(0, 99), f"{epoch}") for _ in range(8)]
        rows = list({(a, b, s): (a, b, s, t) for a, b, s, t in rows}.values())
        batch = spark.createDataFrame(rows, schema)
        table.put(batch, epoch)
        if epoch % 4 == 1:
            table.put(batch, epoch)  # a replay
        for a, b, seq, said in sorted(rows, key=lambda r: r[2]):
            now[a, b] = (seq, said)
        assert table.batches() == epoch + 1
        if epoch in (0, 2, 4, 8, 10):
            assert {(r.a, r.b): (r.seq, r.said) for r in table.read().collect()} == now
    assert size(tmp_path / "runs/0-10") < size(tmp_path / "runs/2-0") / 8
    assert table.live_runs(11) == [(2, 0), (0, 9), (0, 10)]
    assert sorted(os.listdir(tmp_path / "runs")) == ["0-10", "0-9", "2-0"]
    wanted = spark.createDataFrame([("k1",), ("k2999",), (None,), ("absent",)], "a string")
    got = {(r.a, r.b): (r.seq, r.said) for r in table.lookup(wanted).collect()}
    assert got == {k: v for k, v in now.items() if k[0] in ("k1", "k2999", None)}


def events(rng, n, at):
    rows = []
    for k in range(n):
        gap = rng.random() < 0.8
        rows.append({"ontology": rng.choice("AB"), "phrase": rng.choice(["low  Vir", " low vir", "spores", "Spores ", f"p{rng.randint(0, 9)}"]), "outcome": "gap" if gap else "synonym", "pmid": rng.choice(["1", "2", "3", None]), "context": rng.choice([None, "c", "d"]), "matched_term": None if gap else "T", "filed": rng.choice([None] * 9 + [f"f{at + k}"]), "seq": at + k})
    return rows


def test_ranking_equals_the_batch_rank_after_every_batch(spark, tmp_path):
    rng, source = random.Random(2), tmp_path / "in"
    source.mkdir()
    at = 0
    for k in range(7):
        rows = events(rng, 40, at)
        rng.shuffle(rows)
        (source / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(source / f"{k}.json", (1000 + k, 1000 + k))
        at += 40
    ranking, seen = GapRanking(spark, str(tmp_path / "out"), top=4, buckets=3, fan=2), []

    def each(batch, epoch):
        ranking.each(batch, epoch)
        if epoch == 3:
            ranking.each(batch, epoch)  # a replay
        done = spark.read.schema(GAP_EVENT).json([str(source / f"{k}.json") for k in range(epoch + 1)])
        want = ledger.gap_rank(done)
        cols = sorted(want.columns)
        assert sorted(map(repr, ranking.ranking().select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
        best = want.orderBy(*ledger.gap_order()).limit(4).select(cols)
        assert [repr(r) for r in ranking.top().orderBy(*ledger.gap_order()).select(cols).collect()] == [repr(r) for r in best.collect()]
        seen.append(epoch)

    stream = spark.readStream.schema(GAP_EVENT).option("maxFilesPerTrigger", 1).json(str(source))
    ranking.counted(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    assert seen == list(range(7))


def test_first_seen_is_never_forgotten(spark, tmp_path):
    """A key that returns after years, and after a restart from the checkpoint, is known."""
    source, out, log = (str(tmp_path / p) for p in ("in", "out", "log"))
    os.mkdir(source)
    schema = "key string, n long, ts timestamp"

    def come(name, rows):
        with open(f"{source}/{name}.json", "w") as f:
            f.write("\n".join(json.dumps({"key": k, "n": n, "ts": ts}) for k, n, ts in rows))
        with jobs.rocksdb(spark):
            rows = spark.readStream.schema(schema).json(source)
            jobs.first_seen(rows, "key", "n").writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.n) for r in spark.read.parquet(out).collect())

    assert come("a", [("x", 2, "2020-01-01"), ("x", 1, "2020-01-01"), ("y", 3, "2020-01-02")]) == [("x", 1), ("y", 3)]
    assert come("b", [("z", 9, "2030-01-01")]) == [("x", 1), ("y", 3), ("z", 9)]
    assert come("c", [("x", 0, "2040-01-01"), ("y", 0, "2019-01-01"), ("w", 4, "2001-01-01")]) == [("w", 4), ("x", 1), ("y", 3), ("z", 9)]


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    files = [[("s", "2020-01-01 10:00:00", 1), ("s", "2020-01-01 10:04:00", 2)], [("s", "2020-01-01 11:00:00", 4)], [("s", "2020-01-01 11:01:00", 1)], [("s", "2020-01-01 10:01:00", 8), ("s", "2020-01-01 10:55:00", 16)], [("s", "2020-01-02 00:00:00", 32)]]
    for k, rows in enumerate(files):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"session": s, "ts": t, "tokens": n}) for s, t, n in rows))
        os.utime(source / f"{k}.json", (1000 + k, 1000 + k))
    turns = spark.readStream.schema("session string, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).json(str(source))
    got = jobs.run_to_table(jobs.tokens_by_window(turns, "5 minutes", late="10 minutes"), "append")
    found = {r.start: r.tokens for r in got.collect()}
    # the row of 10:01 came after the watermark had passed 10:50; that of 10:55 was in time
    assert found == {datetime(2020, 1, 1, 10, 0): 3, datetime(2020, 1, 1, 10, 55): 16, datetime(2020, 1, 1, 11, 0): 5}


def some_draft(rng):
    names = "abcd"
    pick = lambda *odd: rng.choice([*names, *odd])
    return {
        "genes": [{"name": pick(), "uniprot": rng.choice(["P1", " ", None])} for _ in range(rng.randint(0, 4))],
        "alleles": [{"name": pick(), "gene": pick("z", None)} for _ in range(rng.randint(0, 4))],
        "genotypes": [{"name": pick(), "alleles": [pick("z", None) for _ in range(rng.randint(0, 2))]} for _ in range(rng.randint(0, 4))],
        "metagenotypes": [{"name": pick(), "pathogen_genotype": pick("z"), "host_genotype": pick(None)} for _ in range(rng.randint(0, 3))],
        "annotations": [
            {"feature_type": rng.choice(["gene", "genotype", "metagenotype", "other", None]), "feature": pick("z"), "annotation_type": rng.choice(["molecular_function", "physical_interaction", "x", "wt_rna_expression"]),
             "term_id": rng.choice(["GO:0000001", " ", None, "GO:0000009", "XX:1", "GO:1"]), "term_name": rng.choice(["q", ""]), "note": rng.choice(["not assayed", None]), "hold": rng.choice([True, False, None]), "hold_reason": rng.choice(["r", None])}
            for _ in range(rng.randint(0, 5))
        ],
    }


def test_folded_cascade_equals_the_joins(spark):
    rng = random.Random(3)
    rows = [(k, json.dumps(some_draft(rng))) for k in range(150)] + [(998, "{}"), (999, None)]
    came = spark.createDataFrame(rows, "draft long, said string").select("draft", F.from_json("said", CANTO).alias("canto")).cache()
    index = spark.createDataFrame([("GO:0000001", "x", False)], "term_id string, label string, obsolete boolean")
    got = jobs.parked(came, index, ("GO",), sections=("x", "molecular_function"))

    part = lambda field: came.select("draft", F.explode(f"canto.{field}").alias("p"))
    genes = drafts.gene_state(part("genes").select("draft", "p.name", F.col("p.uniprot").alias("accession")))
    alleles = drafts.child_state(part("alleles").select("draft", "p.name", F.col("p.gene").alias("parent")), genes)
    genotypes = drafts.child_state(part("genotypes").select("draft", "p.name", F.explode_outer("p.alleles").alias("parent")), alleles)
    meta = drafts.child_state(part("metagenotypes").select("draft", "p.name", F.explode(F.array("p.pathogen_genotype", "p.host_genotype")).alias("parent")), genotypes)
    worst = F.when(F.bool_or(F.col("problem") == drafts.UNDEFINED), drafts.UNDEFINED).when(F.bool_or(F.col("problem") == drafts.HELD), drafts.HELD)
    states = None
    for kind, level in (("gene", genes), ("genotype", genotypes), ("metagenotype", meta)):
        level = level.groupBy("draft", "name").agg(worst.alias("problem")).withColumn("feature_type", F.lit(kind))
        states = level if states is None else states.unionByName(level)
    bad = {"GO:0000009": "not_found", "XX:1": "unknown_prefix", "GO:1": "format_invalid"}
    status = F.create_map(*[F.lit(x) for kv in bad.items() for x in kv])
    a = came.select("draft", F.posexplode("canto.annotations").alias("ord", "a")).select("draft", "ord", "a.*")
    a = a.withColumns({"type": F.col("annotation_type"), "bad_term": F.try_element_at(status, F.col("term_id"))})
    want = drafts.queue_items(a, states, sections=("x", "molecular_function"))
    cols = ["draft", "ord", "disposition", "reason"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    reasons = {r.reason for r in got.collect()}
    assert {"", "subject held", "subject undefined", "gene held", "no term", "not assayed", "no section"} <= reasons
