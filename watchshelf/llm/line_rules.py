"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed. Per host a line counts once for each
distinct document (documents of equal text are one). Lines found in more than max_share of the host's documents, and in
more than min_docs (so few that it only spares tiny hosts), are removed from the texts, and documents that keep fewer
than min_words words or less than min_rest of their words are rejected. Two fixed rules come first: too few words, or
too many words in repeated five-word windows.

The removed lines of all hosts are broadcast while they take at most max_broadcast bytes, so no text is shuffled;
beyond that they are joined to the documents.

Defined results: null text has no words and stays null; null hosts form one host of their own; repeated rows each get
the same verdict; a null key is carried along; a line exactly at a limit stays; the work for a very long text grows in
proportion to it; empty tables give empty results. Columns of the input other than key, text and host are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, per_batch, same, table

SYMBOLS = b"#*$%&|<>"
NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Bytes of hosts and hashes of removed lines that a broadcast may hold.
MAX_BROADCAST = 30_000_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of that many words found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count, hit = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit[i : i + width] = b"\1" * width
    return sum(hit)


def _line_hash(own: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(own).lower()))


def without(data: bytes, gone: set[int]) -> bytes:
    """The text without the lines of these hashes; lines without words stay."""
    return b"\n".join(line for line in data.split(b"\n") if not (own := line.split()) or _line_hash(own) not in gone)


def profile(data: bytes) -> dict:
    words, seen, n_dup = data.split(), set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            n_dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": len(b"".join(words).decode("utf-8", "replace")), "n_symbols": sum(data.count(bytes([c])) for c in SYMBOLS), "n_dup_lines": n_dup, "n_repeat_words": repeated_words(words),
    }


def _profiles(batch: pa.RecordBatch) -> pa.RecordBatch:
    """host, doc (a hash of the text) and the hashes of the text's lines."""
    lines, docs = [], []
    for x in batch.column("data").to_pylist():
        data = x or b""
        docs.append(_signed(xxhash.xxh64_intdigest(data)))
        lines.append(list({_line_hash(own) for line in data.split(b"\n") if (own := line.split())}))
    return pa.RecordBatch.from_pydict({"host": batch.column("host"), "doc": pa.array(docs, pa.int64()), "lines": pa.array(lines, pa.list_(pa.int64()))})


def _judged(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
    """The numbers of each text, and the text without its host's removed lines."""
    texts = batch.column("data").to_pylist()
    rows = [profile(x or b"") for x in texts]
    cleaned = [without(x, g) if x and g else x for x, g in zip(texts, gone, strict=True)]
    numbers = {n: pa.array([r[n] for r in rows], pa.int64()) for n in NUMBERS}
    return pa.RecordBatch.from_pydict({"k": batch.column("k")} | numbers | {"cleaned": pa.array(cleaned, pa.binary()), "rest": pa.array([len((x or b"").split()) for x in cleaned], pa.int64())})


def frequent_lines(rows: DataFrame, ws: Workspace, max_share: float, min_docs: int) -> DataFrame:
    """host and h of the lines above the limits. rows: host and data."""
    seen = ws.save(rows.select("host", "data").mapInArrow(per_batch(_profiles), "host string, doc long, lines array<long>").groupBy("host", "doc").agg(F.first("lines").alias("lines")), "seen")
    often = seen.select("host", F.explode("lines").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    hosts = seen.groupBy("host").agg(F.count("*").alias("docs"))
    return ws.save(same(often, hosts, ["host"], "inner").filter(F.col("n") > F.col("docs") * max_share).select("host", "h"), "frequent")


def line_rules(
    docs: DataFrame, max_share: float = 0.02, min_docs: int = 5, min_words: int = 10, min_rest: float = 0.5, max_repeat_percent: int = 20, text: str = "text", key: str = "doc_id", host: str = "source",
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """One row for each row of docs: the base columns, base_failed, n_line_words (words in removed lines), kept and cleaned, the text without its removed lines."""
    ws = Workspace(docs.sparkSession, "line-rules")
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("binary").alias("data"), docs[host].cast("string").alias("host"))
    above = frequent_lines(rows, ws, max_share, min_docs)
    shape = "k long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", cleaned binary, rest long"
    if (above.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 48)).first()[0] or 0) <= max_broadcast:
        removed: dict[str | None, set[int]] = {}
        for r in above.collect():
            removed.setdefault(r["host"], set()).add(r["h"])
        shared = docs.sparkSession.sparkContext.broadcast(removed)
        judged = rows.mapInArrow(per_batch(lambda batch: _judged(batch, [shared.value.get(h) for h in batch.column("host").to_pylist()])), shape)
    else:
        listed = rows.withColumn("doc", F.xxhash64("data"))
        hit = listed.mapInArrow(per_batch(_lines_of), "k long, host string, doc long, h long")
        gone = same(hit, above, ["host", "h"], "left_semi").groupBy("k", "host", "doc").agg(F.collect_set("h").alias("gone"))
        judged = same(listed, gone, ["k", "host", "doc"], "left").select("k", "data", "gone").mapInArrow(per_batch(lambda batch: _judged(batch, [set(x or ()) for x in batch.column("gone").to_pylist()])), shape)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~failed & (F.col("rest") >= min_words) & (F.col("rest") >= F.col("n_words") * min_rest)
    return judged.select(F.col("k").alias(key), *NUMBERS, failed.alias("base_failed"), (F.col("n_words") - F.col("rest")).alias("n_line_words"), kept.alias("kept"), F.col("cleaned").cast("string").alias("cleaned"))


def _lines_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each distinct line of each text."""
    at, found = [], []
    for i, x in enumerate(batch.column("data").to_pylist()):
        own = {_line_hash(words) for line in (x or b"").split(b"\n") if (words := line.split())}
        at += [i] * len(own)
        found += own
    rows = pa.array(at, pa.int64())
    return pa.RecordBatch.from_pydict({c: batch.column(c).take(rows) for c in ("k", "host", "doc")} | {"h": pa.array(found, pa.int64())})


def op9_line_rules(spark, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("cleaned")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), l AS (
  SELECT doc_id, source, text, u.i AS i, u.s AS s, list_filter(regexp_split_to_array(u.s, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, source, text, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 's': x})) AS u FROM d)
), v AS (
  SELECT *, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
         row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS nth
  FROM l WHERE len(ws) > 0
), dup AS (
  SELECT doc_id, count(*) AS n FROM v WHERE nth > 1 GROUP BY doc_id
), often AS (
  SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM v GROUP BY source, norm) f
  JOIN (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source) h USING (source)
  WHERE f.n > 5 AND f.n > h.docs * 0.02
), gone AS (
  SELECT doc_id, sum(len(ws)) AS n FROM v SEMI JOIN often USING (source, norm) GROUP BY doc_id
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5
), gram AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i : i + 4]) AS n FROM g
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM gram WHERE n > 1) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, length(array_to_string(d.ws, ''))::BIGINT AS word_chars,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words,
       NOT base_failed AND n_words - n_line_words >= 10 AND n_words - n_line_words >= n_words * 0.5 AS kept
FROM b
"""
