"""Benchmark decontamination: windows of benchmark words are looked up in every document.

Words are runs of digits, letters a-z (A-Z lower-cased first) and characters beyond ASCII. The benchmark's
windows, ten consecutive words or a whole shorter item, are hashed; while they take at most max_broadcast bytes
the set is broadcast, beyond that the same join shuffles. Windows of the documents that hit are then
compared word by word, so that a collision of hashes never counts.

Defined results: null text has no words; items without words match nothing; an item that comes twice counts
once for each distinct item_id, and items whose id is null count as one together; rows that repeat doc_id and text each
get the same result; a null doc_id is a key like others; with an empty benchmark nothing is hit; the work for a very
long text grows in proportion to its words; an empty table gives an empty result. Other columns are
carried along in one struct, whatever their names. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, same, table

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts that are not lower-cased.
GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of windows, their words included, that a broadcast may hold.
MAX_BROADCAST = 50_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def _hashes(hashes: Column, n: Column, width: int) -> Column:
    """The hash of each window of that many words; of none if there are fewer words."""
    window = lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + j) for j in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), window)).otherwise(F.array().cast("array<long>"))


def _windows(benchmark: DataFrame, width: int, text: str, item: str) -> DataFrame:
    """size, h and words of each distinct window, and the items that have it."""
    items = benchmark.select(benchmark[item].alias("item"), _words(benchmark[text]).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(width)))
    starts = items.select("item", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    part = starts.select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("words"))
    part = part.groupBy("size", "words").agg(F.collect_set(F.struct("item")).alias("items"))  # in a struct, null is an item too
    chosen = F.lit(None).cast("long")
    for n in range(1, width + 1):
        chosen = F.when(F.col("size") == n, F.xxhash64(F.lit(n), *[F.xxhash64(F.get("words", F.lit(j))) for j in range(n)])).otherwise(chosen)
    return part.select("size", "words", "items", chosen.alias("h"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row for each row of docs: k, t (a hash of the text), n_words, hit (positions of hit words) and items.

    One scan hashes the windows of all sizes of a text, size after size; the place in that list tells where a window starts.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    windows = ws.save(_windows(benchmark, width, text, item), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most width values
    held = F.aggregate("words", F.lit(16).cast("long"), lambda n, w: n + F.octet_length(w) + 32) + 32 * F.size("items")
    small = (windows.agg(F.sum(held)).first()[0] or 0) <= max_broadcast
    own = docs.select(docs[key].alias("k"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("t"), docs[text].alias("text"))
    counts = own.select("k", "t", F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    if not sizes:
        return counts.select("*", F.lit(None).cast("array<int>").alias("hit"), F.lit(None).cast(f"array<{benchmark.schema[item].dataType.simpleString()}>").alias("items"))
    hashed = own.select("k", "t", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    every = [_hashes(F.col("hs"), F.size("hs"), n) for n in sizes]
    # The list is a column of its own before it is exploded, or each window would carry all hashes of the text; and
    # posexplode_outer keeps Spark from adding a filter on the list's size that computes it once more for each window.
    listed = hashed.select("k", "t", F.size("hs").alias("n"), (F.concat(*every) if len(every) > 1 else every[0]).alias("windows"))
    scanned = listed.select("k", "t", "n", F.posexplode_outer("windows").alias("at", "h"))
    keys = windows.select("size", "h").distinct()
    met = scanned.join(F.broadcast(keys) if small else keys, "h")
    before, skipped = F.lit(0), F.lit(0)
    for n in sizes:
        before = F.when(F.col("size") == n, skipped).otherwise(before)
        skipped = skipped + F.greatest(F.col("n") - (n - 1), F.lit(0))
    places = met.select("k", "t", F.struct((F.col("at") - before).alias("at"), "size", "h").alias("w")).groupBy("k", "t").agg(F.collect_set("w").alias("ws"))
    read = same(own, places, ["k", "t"], "inner")
    # the outer transform over one element splits the text once, not once for each hit
    part = lambda words, w: F.struct(w["at"].alias("at"), w["size"].alias("size"), w["h"].alias("h"), F.slice(words, w["at"] + 1, w["size"]).alias("words"))
    parts = F.flatten(F.transform(F.array(_words(F.col("text"))), lambda words: F.transform("ws", lambda w: part(words, w))))
    pairs = read.select("k", "t", parts.alias("parts")).dropDuplicates(["k", "t"]).select("k", "t", F.explode_outer("parts").alias("p")).select("k", "t", "p.*")
    sure = pairs.join(F.broadcast(windows) if small else windows, ["size", "h", "words"])
    hits = sure.groupBy("k", "t").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    hits = ws.save(hits.select("k", "t", hit.alias("hit"), F.transform(F.array_distinct("items"), lambda x: x["item"]).alias("items")), "hits")
    return same(counts, hits, ["k", "t"], "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold benchmark windows, or ("spans") without the words in such windows.

    In mode "spans" a removed word goes with the gap after it, which leaves every other character as it was.
    """
    report = contamination(docs, benchmark, text=text, key=key, **options).filter(F.size("hit") > 0).dropDuplicates(["k", "t"])
    keyed = docs.select(docs[key].alias("k"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("t"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    if mode == "documents":
        return same(keyed, report, ["k", "t"], "left_anti").select("row.*")
    if mode != "spans":
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    joined = same(keyed, report.select("k", "t", "hit"), ["k", "t"], "left")
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    pieces = F.regexp_extract_all(whole, F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    lead = F.regexp_extract(whole, "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    bound = F.array(F.struct(pieces.alias("pieces"), F.col("hit").alias("hit")))  # the outer transform cuts the text into pieces once
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["pieces"]) - 1), x["hit"])
    cut = F.concat(lead, F.get(F.transform(bound, lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x["pieces"], i)), "")), F.lit(0)))
    return joined.select(*[F.when(F.col("hit").isNull(), F.col("row")[c]).otherwise(cut).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.coalesce(F.col("items").cast("array<string>"), F.array().cast("array<string>")))
    return found.select(
        F.col("k").alias("doc_id"), "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.coalesce(F.size("hit") > 0, F.lit(False)).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, ws[i : i + least(len(ws), 10) - 1] AS gram
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), s AS (
  SELECT DISTINCT size FROM g
), w AS (
  SELECT doc_id, i, size, ws[i : i + size - 1] AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, s WHERE len(ws) >= size)
), h AS (
  SELECT doc_id, i, w.size AS size, item_id FROM w JOIN g ON w.size = g.size AND w.gram = g.gram
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
