"""Quoted records over many splits equal those of one task."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import quoted, readers


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def write_release(path, n, seed, end="\n", head=("Record ID", "Gene_name", "PMID", "Literature_source", "Phenotype_of_mutant"), bom=""):
    rng = random.Random(seed)
    rows = [[str(k), rng.choice(["a", "b, c", 'say "x"', "", "two\nlines", 'q"\n"\n', "\n\n"]), str(rng.randint(1, 9)), "Pubmed", rng.choice(["x" * rng.randint(0, 150), "é\n" * rng.randint(0, 60), "'"])] for k in range(n)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(bom)
        w = csv.writer(f, lineterminator=end)
        w.writerow(head)
        w.writerow(head)
        w.writerows(rows)
    return rows


@pytest.mark.parametrize("bound", [quoted.BROADCAST_SPLITS, 0])
def test_many_splits_equal_one_reader(spark, tmp_path, small_splits, bound):
    rows = write_release(tmp_path / "r.csv", 150, 1, bom="﻿")
    assert quoted._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = readers.read_release(spark, str(tmp_path), broadcast_splits=bound).collect()
    want = sorted(map(repr, (tuple(x or None for x in r) for r in rows)))
    assert sorted(map(repr, ((r.record_id, r.gene, r.pmid, r.source, r.phenotype) for r in got))) == want
    lone = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"').where("`Record ID` <> 'Record ID'")
    assert sorted(map(repr, (tuple(r) for r in lone.collect()))) == want


def test_heads_differ_between_files(spark, tmp_path, small_splits):
    write_release(tmp_path / "old.csv", 40, 2)
    write_release(tmp_path / "new.csv", 40, 3, end="\r\n", head=("Gene", "Record ID", "Literature_ID", "x", "Phenotype_of_mutant"))
    got = readers.read_release(spark, str(tmp_path))
    assert got.count() == 80
    new = got.where("source is null")
    assert new.count() == 40 and new.where("gene rlike '^[0-9]+$'").count() == 40
    assert got.where("host is not null or species is not null").count() == 0


def test_records_on_borders(spark, tmp_path, small_splits):
    """One record of many splits, a blank line, an open cell at the end."""
    long = '1,"' + "line, of a cell\n" * 60 + '"'
    (tmp_path / "x.csv").write_text(f'a,b\n{long}\n\n2,"x"\n3,"never\nclosed\n')
    got = sorted(r.record for r in quoted.read_records(spark, str(tmp_path)).collect())
    assert got == sorted(["a,b", long, '2,"x"', '3,"never\nclosed'])
    (tmp_path / "x.csv").write_text("")
    assert readers.read_release(spark, str(tmp_path)).collect() == []


def test_splits_that_begin_inside_a_cell(spark, tmp_path, small_splits):
    (tmp_path / "y.csv").write_text('a\n"' + "x\n" * 400 + '"\n')
    inside = quoted._starts(quoted._lines(spark, str(tmp_path)), '"')
    blocks = {r.block for r in inside.collect()}
    every = {r.block for r in quoted._lines(spark, str(tmp_path)).select("block").distinct().collect()}
    assert blocks == every - {0}
    assert quoted.read_records(spark, str(tmp_path)).select(F.length("record")).collect()[-1][0] in (1, 802)
