"""The index of three-letter runs against a scan of all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from handbill.operators import search

BUCKETS = 16


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 12)))
    data = [(i, word(), word() if i % 3 else None, "Shared TEXT of many" if i % 2 else "") for i in range(600)]
    rows = spark.createDataFrame(data, "n long, one string, two string, three string")
    path = str(tmp_path_factory.mktemp("index"))
    search.write_index(rows, "n", [F.col("one"), F.col("two"), F.col("three")], path, BUCKETS)
    return data, path


@pytest.mark.parametrize("query", ["abc", "ABCD", " cde ", "ed", "a", "shared text", "text of many", "xyz", "éa", "a b c", "%", "abcabc"])
def test_same_rows_as_a_scan(spark, index, query):
    data, path = index
    wanted = query.strip().lower()
    want = sorted(n for n, *texts in data if any(wanted in (t or "").lower() for t in texts))
    assert sorted(r.key for r in search.find(spark, path, query, BUCKETS).collect()) == want


def test_a_blank_query_is_held_by_all(spark, index):
    data, path = index
    assert search.find(spark, path, "  ", BUCKETS).count() == sum(any(t) for _, *t in data)


def test_a_query_reads_the_buckets_of_its_runs(spark, index):
    _, path = index
    some = search.candidates(spark, path, "shared text", BUCKETS)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert re.search(r"PushedFilters: \[[^\]]*In\(gram|PushedFilters: \[[^\]]*gram", plan)
    assert search.candidates(spark, path, "ab", BUCKETS) is None
    assert some.count() == 1
    # The one text of a run that half of the rows have is read once.
    assert spark.read.parquet(f"{path}/texts").where("text = 'shared text of many'").count() == 1


def test_an_empty_table_is_searched(spark, tmp_path):
    rows = spark.createDataFrame([], "n long, one string")
    search.write_index(rows, "n", [F.col("one")], str(tmp_path / "none"), 2)
    for query in ("abc", "a", ""):
        assert search.find(spark, str(tmp_path / "none"), query, 2).count() == 0
