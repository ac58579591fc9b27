"""Comparisons that ignore case, and the keyword index against the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from watchshelf.functions.collation import binary, ignoring_case
from watchshelf.operators.keywords import KeywordIndex, grams

ROWS = [(1, "Anna"), (2, "ANNA"), (3, "ánna"), (4, None), (5, ""), (6, "bob"), (7, "an"), (8, "banANAnna % _")]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(ROWS, "id long, name string")


def test_comparisons_ignore_case(names):
    own = ignoring_case(names)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(own.filter(F.col("name") == "aNNa")) == [1, 2]
    assert ids(own.filter(F.col("name").isin("ANNA", "BOB"))) == [1, 2, 6]
    assert ids(own.filter(F.col("name").like("AN%"))) == [1, 2, 7]
    assert own.select("name").distinct().count() == 7
    assert {r["count"] for r in own.filter("name = 'anna'").groupBy("name").count().collect()} == {2}
    assert own.join(ignoring_case(names.limit(2)).select(F.upper("name").alias("name")), "name").count() == 4
    assert binary(own).filter(F.col("name") == "anna").count() == 0 and sorted(map(str, binary(own).collect())) == sorted(map(str, names.collect()))


@pytest.mark.parametrize("keyword", ["anna", "ANA", "nan", "% _", "zzz", "an", "", "a", "ánn"])
def test_any_keyword_finds_what_a_scan_finds(names, keyword):
    index = KeywordIndex(names, "id", "name", buckets=8)
    expected = sorted(i for i, x in ROWS if x is not None and keyword.lower() in x.lower())
    assert sorted(r.id for r in index.search(keyword).collect()) == expected


def test_a_search_reads_its_buckets_only(names):
    index = KeywordIndex(names, "id", "name", buckets=8)
    plan = index.matches("anna")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(grams("anna")) == 2 and grams("an") == []
