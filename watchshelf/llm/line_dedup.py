"""Line dedup: windows of three consecutive lines that occur more than once keep their first occurrence.

Lines are split at \\n and compared without surrounding blanks; lines without a visible character form no
window, but go when they lie between lines of one removed window. A window is later if an equal one comes
before it in the order of (doc_id, position), in the same document too. All lines that a later window covers
are removed, and the covered positions of overlapping windows merge.

Defined results: null text is read as empty; fewer than three visible lines: nothing removed; rows that repeat
both doc_id and text are one document and come back as often as they came; rows that share only the doc_id are
separate documents, ordered by a hash of their text; null doc_id sorts first; the work for a very long text grows in
proportion to its lines; an empty table gives an empty result. Other columns pass through, but n_lines and n_removed
of the input are replaced by the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, same, table

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(text: Column, width: int) -> Column:
    """array<struct<first,last,a,b>>: each window's first and last line, and two independent hashes of its lines."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("s")))
    seen = F.transform(F.filter(numbered, lambda x: x.s != ""), lambda x: F.struct(x.i.alias("i"), F.xxhash64(x.s).alias("a"), F.hash(x.s).alias("b")))

    def window(lines: Column, k: Column) -> Column:
        part = [F.get(lines, k + j) for j in range(width)]
        return F.struct(
            part[0]["i"].alias("first"), part[-1]["i"].alias("last"), F.xxhash64(*[p["a"] for p in part]).alias("a"), F.hash(*[p["b"] for p in part]).alias("b")
        )

    # the outer transform over one element binds the list of lines once
    return F.flatten(
        F.transform(
            F.array(seen),
            lambda lines: F.when(F.size(lines) >= width, F.transform(F.sequence(F.lit(0), F.size(lines) - width), lambda k: window(lines, k))).otherwise(
                F.transform(F.slice(lines, 1, 0), lambda x: F.struct(x.i.alias("first"), x.i.alias("last"), x.a.alias("a"), x.b.alias("b")))
            ),
        )
    )


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at those positions. The outer transform over one element splits the text once."""
    bound = F.array(F.struct(_lines(text).alias("lines"), gone.alias("gone")))
    rest = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
    return F.get(F.transform(bound, lambda x: F.array_join(F.transform(rest(x), lambda i: F.get(x["lines"], i)), "\n")), F.lit(0))


def line_dedup(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the removed lines gone from the text, plus n_lines and n_removed (long)."""
    ws = Workspace(docs.sparkSession, "line-dedup")
    text_key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # The list is a column of its own before it is exploded, or each window would carry and hash the whole text; and
    # explode_outer keeps Spark from adding a filter on the list's size that computes all windows once more.
    listed = docs.select(F.col(key).alias("k"), text_key.alias("t"), _windows(F.col(text), width).alias("ws"))
    windows = ws.save(listed.select("k", "t", F.explode_outer("ws").alias("w")).filter("w IS NOT NULL").select("k", "t", "w.*"), "windows")
    place = F.struct("k", "t", "first")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(firsts, ["a", "b"]).filter(~place.eqNullSafe(F.col("kept")))
    covered = later.groupBy("k", "t").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    gone = covered.select("k", "t", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))).alias("__gone"))
    keyed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs[key].alias("k"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("t"))
    joined = same(keyed, gone, ["k", "t"], "left")
    at = docs.columns.index(text)
    whole = F.coalesce(F.col(f"c{at}"), F.lit(""))
    rest = F.when(F.col("__gone").isNull(), whole).otherwise(_without(whole, F.col("__gone")))
    columns = [rest.alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.size(_lines(whole)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.s AS s, trim(u.s, chr(32) || chr(9) || chr(13)) AS v
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i - 1, 's': x})) AS u FROM documents)
), w AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER o AS last, v AS a, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c
  FROM l WHERE v <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS n FROM w WHERE last IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM r WHERE n > 1
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
       coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.s END, chr(10) ORDER BY l.i), '') AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i
GROUP BY l.doc_id
"""
