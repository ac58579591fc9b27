"""From raw documents to a training mix: each stage reads what the one before it has written.

Stages keep whatever columns documents have, whatever their names. Null texts are read as empty by all stages; rows
without a doc_id are judged by their text like others; repeated rows are scored alike, and where the near-duplicate
stage keeps a row it keeps its repeats; empty tables, or stages that keep nothing, give empty results; without trusted
positives the quality stage keeps all documents, without labels the mixing stage keeps each document once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchshelf.llm.common import Workspace, released, table
from watchshelf.llm.decontaminate import decontaminate
from watchshelf.llm.line_dedup import line_dedup
from watchshelf.llm.mixing import TARGETS, labelled_documents, mixed_documents
from watchshelf.llm.quality import keep_good
from watchshelf.llm.similar import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes windows of three lines that came before; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    SimHash fingerprints are linked first and compared exactly; pairs that they miss are found by prefixes of the sets.
    """
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark windows."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the languages meet their target shares; none is thinned out."""
    return mixed_documents(docs, labelled_documents(docs, table(spark, sf_dir, "labels")), TARGETS, least=1.0)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixing", mixing)]

#: SQL has neither the trained classifier nor the fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has saved on its way goes when it has written its result, and so does its predecessor's result."""
    docs, ws, before = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        with released():
            docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return docs
