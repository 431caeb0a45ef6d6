"""Steps over the order tables take rows in shares of bounded size."""

import pytest

from scriptorium.functions import shares
from scriptorium.operators import drafts
from scriptorium.plans import records  # noqa: F401 (registers further queries)
from scriptorium.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["shared_page", "figure_audit", "figure_costs", "queue_summary"])
def test_more_rows_make_more_shares(spark, monkeypatch, name):
    monkeypatch.setattr(shares, "SHARE_ROWS", 700)
    n = shares.shares_of(spark.read.parquet(f"{SF}/lineitem.parquet"))
    few = QUERIES[name](spark, SF)
    assert n > 4 and few.rdd.getNumPartitions() == n
    monkeypatch.setattr(shares, "SHARE_ROWS", 10**9)
    assert sorted(map(str, few.collect())) == sorted(map(str, QUERIES[name](spark, SF).collect()))


def test_links_may_repeat_and_be_dealt(spark):
    genes = spark.createDataFrame([(1, "a", None), (1, "b", "held")], "draft long, name string, problem string")
    links = spark.createDataFrame([(1, "x", "a"), (1, "x", "a"), (1, "x", "b"), (1, "y", "c"), (1, "z", None)], "draft long, name string, parent string")
    want = [("x", "held", []), ("y", "undefined", ["c"]), ("z", None, [])]
    for n in (None, 1, 7):
        got = drafts.child_state(links, genes, n)
        assert sorted((r.name, r.problem, r.missing) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["integrity_errors", "park_items", "queue_counts", "queue_sections"])
def test_what_is_dealt_is_not_dealt_anew_by_spark(spark, monkeypatch, name):
    monkeypatch.setattr(shares, "SHARE_ROWS", 700)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    # only partial counts by level and problem are dealt by Spark itself
    assert plan.count("ENSURE_REQUIREMENTS") == (name == "integrity_errors")
    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(shares, "SHARE_ROWS", 10**9)
    assert sorted(map(str, QUERIES[name](spark, SF).collect())) == want
