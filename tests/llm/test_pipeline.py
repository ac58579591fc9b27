"""The five stages on nulls, repeats, long texts, clashing columns and empty tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from watchshelf.llm.common import Workspace, table

from conftest import DATA

CLASHING = ("k", "t", "data", "row", "rate", "root", "n_lines", "hit", "p", "words")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = table(spark, str(DATA), "documents")
    some = docs.filter("doc_id < 60")
    nulls = spark.createDataFrame([(9000, None, None, None, None), (None, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "a b " * 100_000, "en", "s", 5)], docs.schema)
    keyless = some.filter("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long"))
    odd = docs.unionAll(some).unionAll(nulls).unionAll(keyless).withColumns({c: F.lit("clash") for c in CLASHING})
    odd.write.parquet(f"{folder}/documents.parquet")
    labels = table(spark, str(DATA), "labels")
    labels.unionAll(labels.limit(5)).unionAll(labels.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionAll(labels.limit(3).withColumn("quality", F.lit(None).cast("int"))).write.parquet(f"{folder}/labels.parquet")
    table(spark, str(DATA), "benchmark").unionAll(spark.createDataFrame([(None, "one two"), (7, None), (8, "")], "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_odd_rows(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    ws, columns = Workspace(spark, "test-odd"), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), ws.save(stage(spark, docs, odd_dir), name)
        assert docs.columns == columns and 0 < docs.count() <= before
    kept = docs.select("doc_id").distinct().count()
    mixed = corpus_pipeline.mixing(spark, docs, odd_dir)
    assert set(columns) - {"rate"} <= set(mixed.columns) and {"n_tokens", "rate", "copy"} <= set(mixed.columns)
    assert mixed.select("doc_id").distinct().count() == kept
    assert mixed.filter("k <> 'clash'").count() == 0


def test_stages_without_rows_or_labels(spark, odd_dir, tmp_path):
    for n in ("documents", "labels", "benchmark"):
        table(spark, odd_dir, n).limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = table(spark, str(DATA), "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), odd_dir).count() == 0
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.benchmark(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).count() == docs.count()
