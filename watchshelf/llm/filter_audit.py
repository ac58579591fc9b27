"""How five filters work in each other's company: what each removes, wherever it stands in the order.

Each document is replayed under each order of the filters. One pass over the texts leaves a row of flags for each
document (which filters it fails, whether it is labelled as good or toxic); every row meets the 120 orders, which are
broadcast (a fixed number of rows), its five steps are exploded, and the place of its first failure in that order says
what each step does to it. Sums by part, order and step combine before they are shuffled, so that what is shuffled
grows with parts and tasks, not with documents. A filter's removals summed over all orders are its shapley figure.

A document is a copy if a smaller doc_id has the same text anywhere in the table; texts are compared by their SHA-256,
whose least doc_id is found by a minimum that combines before the shuffle and is joined back to slim rows, in a join
whose skewed partitions Spark splits, so a text that a third of all rows share is split too.

Defined results: null text is empty, null part the empty string; an empty text fails A alone (and E where it is a copy);
documents without a doc_id count, but are no copies and have none; rows that share doc_id and text are no copies of
each other; of several labels of a document any 1 counts, and labels that are null or lack a doc_id none; a very long
text is one row of work, linear in its length; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD_BREAKS, Workspace, table

FILTERS = "ABCDE"
SIGNS = "#$%&*|"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; the words are split once."""
    text = F.coalesce(text, F.lit(""))
    # what stands before the first and after the last break may be empty, nothing else
    words = lambda x: F.filter(F.split(x, WORD_BREAKS), lambda w: w != "")
    removed = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    flag = lambda name, failed: F.when(failed, F.lit(BIT[name])).otherwise(F.lit(0))
    by_words = F.element_at(F.transform(F.array(words(text)), lambda w: flag("A", F.size(w) < 50) + flag("B", 100 * F.size(F.array_distinct(w)) < 65 * F.size(w))), 1)
    return by_words + flag("C", 100 * removed(text, UPPER) > 5 * F.length(text)) + flag("D", removed(text, SIGNS) > 0)


def flagged(docs: DataFrame, labels: DataFrame, ws: Workspace, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """part, fails (bits), good and toxic of each document."""
    slim = docs.select(
        docs[key].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text_failures(docs[text]).alias("fails"),
        F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)).alias("sha"),
    )
    slim = ws.save(slim, "flags")
    # written, so that the join meets plain shuffles on both sides, which Spark can split
    first = ws.save(slim.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    copy = F.when(F.col("id") > F.col("first"), F.lit(BIT["E"])).otherwise(F.lit(0))
    one = lambda c: F.max(labels[c] == 1).alias(c)
    marks = ws.save(labels.filter(labels[key].isNotNull()).groupBy(labels[key].alias("id")).agg(one("quality"), one("toxic")), "marks")
    rows = slim.join(first, "sha", "left").select("id", "part", (F.col("fails") + copy).alias("fails")).join(marks, "id", "left")
    return rows.select("part", "fails", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """All orders: filter_order, and steps as an array of (step, bit)."""
    rows = [("".join(o), [(i, BIT[f]) for i, f in enumerate(o, 1)]) for o in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step:int,bit:int>>")


def replay(rows: DataFrame, ws: Workspace) -> DataFrame:
    """rows: part, fails, good, toxic. One row for each part, order and step."""
    crossed = rows.crossJoin(F.broadcast(orders(rows.sparkSession)))
    first: Column = F.lit(len(FILTERS) + 1)
    for i in range(len(FILTERS), 0, -1):
        first = F.when(F.col("fails").bitwiseAND(F.col("steps")[i - 1]["bit"]) != 0, F.lit(i)).otherwise(first)
    stepped = crossed.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), F.explode("steps").alias("at"))
    stepped = stepped.select("part", "filter_order", "at.step", "at.bit", "fails", "good", "toxic", "first")
    fails, here = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("step")
    count = lambda name, what: F.count(F.when(what, 1)).alias(name)
    sums = stepped.groupBy("part", "filter_order", "step").agg(
        count("kept", F.col("first") > F.col("step")), count("removed", here), count("redundant", fails & (F.col("first") < F.col("step"))), count("unique_fails", F.col("fails") == F.col("bit")),
        count("good_lost", here & F.col("good")), count("toxic_lost", here & F.col("toxic")),
    )
    sums = ws.save(sums, "sums")
    letter = F.substring("filter_order", F.col("step"), 1)
    shapley = sums.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return sums.withColumn("letter", letter).join(shapley, ["part", "letter"]).drop("letter").select(*sums.columns, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """part, filter_order, step and the counts of documents: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    ws = Workspace(docs.sparkSession, "filter-audit")
    return replay(flagged(docs, labels, ws, part, text, key), ws)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), d AS (
  SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
                        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w
), m AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), l(c, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
o AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order, [a.i, b.i, x.i, y.i, z.i] AS places
  FROM l a, l b, l x, l y, l z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5
), r AS (
  SELECT part, filter_order, list_transform(places, lambda p: fails[p]) AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN m USING (doc_id) CROSS JOIN o
), s AS (
  SELECT *, unnest([1, 2, 3, 4, 5]) AS step, coalesce(list_position(f, true), 6) AS first, len(list_filter(f, lambda x: x)) AS n FROM r
), t AS (
  SELECT part, filter_order, step::INTEGER AS step, substring(filter_order, step, 1) AS letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (f[step] AND first < step) AS redundant, count(*) FILTER (f[step] AND n = 1) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t
"""
