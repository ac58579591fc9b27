"""Prefix tries of conversations: which beginnings are shared, by how many, and what a cache of them would save.

A conversation is a path of turns, in a row of its own: for each turn 16 bytes of a SHA-256 of role and text, and 4
bytes with the length of the text; texts leave the scan in no other form. Equal paths become one row first: their
ids are joined in bounded ranges of ids before the shuffle, and then run through a streaming digest in sorted order,
so a group of copies of any size takes no memory. The distinct paths are dealt to buckets by the digest of their first turn, and in
each bucket applyInPandas builds tries of dictionaries of pointers and rolls them up in an iterative postorder.

First turns whose paths have more than max_turns turns left are dealt anew by the next turn, again and again, until no
group is larger (a lone path is never split); so no task gets much more than max_turns turns, however many
conversations begin alike. The nodes above such splits, and the root, are sums over the tops of the tries below them.

Defined results: null role and text are empty; turns are sorted by turn, nulls first, then role, then digest, and repeated rows are
turns of their own; rows without a conv_id belong to no conversation and are left out; a very long text costs its
digest; a conversation is one row of 20 bytes a turn; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

#: Bytes of a turn in a path, and of its digest.
TURN, DIGEST = 20, 16
#: So many turns make a trie of about a hundred megabytes.
MAX_TURNS = 200_000
NO_ENDS = hashlib.sha256().hexdigest()
_PATHS = "conv_id long, n_convs long, path binary, ends string"
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _part(column: str, start: Column | int, length: Column | int | None = None) -> Column:
    """Bytes of a binary column, from 0."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(F.col(column), start + 1, F.lit(1 << 30) if length is None else F.lit(length) if isinstance(length, int) else length)


def turn_paths(conversations: DataFrame, group: Column | None = None) -> DataFrame:
    """conv_id and path of each conversation of (conv_id, turn, role, text); with group, a function of conv_id, rows of a group are in one partition."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    size = F.lpad(F.hex(F.octet_length(text)), 2 * (TURN - DIGEST), "0")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), F.concat(digest, size).alias("item")).alias("turn")).filter("conv_id IS NOT NULL")
    keys = ["conv_id"]
    if group is not None:
        rows, keys = rows.withColumn("group", group).repartition("group"), ["group", "conv_id"]
    own = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return own.select(*keys, F.unhex(F.array_join(F.transform("turns", lambda x: x["item"]), "")).alias("path"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and path, in which the first crc32(conv_id) % 9 turns are those of the conversation conv_id - conv_id % 5."""
    own = turn_paths(conversations, F.col("conv_id") - F.col("conv_id") % 5)
    five = own.groupBy("group").agg(F.max(F.when(F.col("conv_id") == F.col("group"), _part("path", 0, 8 * TURN))).alias("head"), F.collect_list(F.struct("conv_id", "path")).alias("convs"))
    each = five.select("head", F.inline("convs")).withColumn("h", TURN * (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    return each.select("conv_id", F.concat(F.coalesce(_part("head", 0, F.col("h")), F.lit(b"")), _part("path", F.col("h"))).alias("path"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each path, from rows sorted by path and range of ids."""
    key, running, row = None, None, None

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["conv_id", "n_convs", "path", "ends"])

    for batch in batches:
        done = []
        for k, ids, n, low, path in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "n", "low", "path")), strict=True):
            if k == key:
                running.update(b"," + ids.encode())
                row[1] += n
                continue
            if row:
                done.append((*row, running.hexdigest()))
            key, running, row = k, hashlib.sha256(ids.encode()), [low, n, path]
        if done:
            yield out(done)
    if row:
        yield out([(*row, running.hexdigest())])


def distinct_paths(convs: DataFrame) -> DataFrame:
    """convs: conv_id (unique) and path. Each path once, with its smallest conv_id, its number of conversations and the digest of their ids."""
    keyed = convs.select("conv_id", "path", F.unhex(F.sha2("path", 256)).alias("key"), F.shiftright("conv_id", 12).alias("range"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    ranges = keyed.groupBy("key", "range").agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("path").alias("path"))
    return ranges.repartition("key").sortWithinPartitions("key", "range").drop("range").mapInArrow(_digests, _PATHS)


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries of these rows (conv_id, n_convs, path, ends; level and key of the top, up and up_conv of the node above it)."""
    tops: dict[tuple, int] = {}
    kids: list[dict[bytes, int] | None] = []  # by node: the nodes below it by digest
    low, convs, size, depth, above, ends, over, top = [], [], [], [], [], [], [], []

    def node(at: int, path: bytes, place: int, up_conv: int, up: bytes | None) -> int:
        for x, y in ((kids, None), (low, 1 << 63), (convs, 0), (size, int.from_bytes(path[place + DIGEST : place + TURN])), (depth, place // TURN + 1), (above, at), (ends, NO_ENDS), (over, up_conv), (top, up)):
            x.append(y)
        return len(kids) - 1

    for conv, n, path, ended, level, key, up, up_conv in zip(*(rows[c] for c in ("conv_id", "n_convs", "path", "ends", "level", "key", "up", "up_conv")), strict=True):
        at = -1
        for place in range((level - 1) * TURN, len(path), TURN):
            if at < 0:
                if (at := tops.get((level, key), -1)) < 0:
                    at = tops[level, key] = node(-1, path, place, up_conv, up)
            else:
                if (below := kids[at]) is None:
                    below = kids[at] = {}
                digest, on = path[place : place + DIGEST], at
                if (at := below.get(digest, -1)) < 0:
                    at = below[digest] = node(on, path, place, 0, None)
            convs[at] += n
            low[at] = min(low[at], conv)
        ends[at] = ended
    leaves, saved = [0] * len(kids), [(n - 1) * s for n, s in zip(convs, size, strict=True)]
    order, waiting = [], list(tops.values())
    while waiting:
        order.append(at := waiting.pop())
        waiting.extend((kids[at] or {}).values())
    for at in reversed(order):  # a node comes after all below it
        leaves[at] = leaves[at] or 1
        if (on := above[at]) >= 0:
            leaves[on] += leaves[at]
            saved[on] += saved[at]
    parents = [low[on] if on >= 0 else c for on, c in zip(above, over, strict=True)]
    return pd.DataFrame({
        "conv_id": low, "depth": depth, "parent_conv_id": parents, "n_convs": convs, "n_children": [len(x or ()) for x in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "up": top,
    })


def prefix_trie(convs: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """convs: conv_id (unique) and path, as of turn_paths. One row for each node, the root included; a node is told by conv_id, its smallest member, and depth."""
    ws = Workspace(convs.sparkSession, "prefix-trie")
    paths = ws.save(distinct_paths(convs), "paths")
    turns = F.length("path") / TURN
    first = paths.agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max(F.when(F.length("path") == 0, F.col("ends"))).alias("ends"), F.sum(turns).alias("turns")).first()
    if first["n_convs"] is None:
        return convs.sparkSession.createDataFrame([], _NODES)
    root = convs.sparkSession.createDataFrame([(b"", first["conv_id"], first["n_convs"], first["ends"], 0, None, None)], "key binary, conv_id long, n_convs long, ends string, size long, up binary, up_conv long")
    spine, groups = [root], []
    live = paths.filter(F.length("path") > 0).withColumns({"key": _part("path", 0, DIGEST), "up": F.lit(b""), "up_conv": F.lit(first["conv_id"])})
    while True:
        level = len(spine)
        sizes = live.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max(F.when(turns == level, F.col("ends"))).alias("ends"),
            F.conv(F.hex(F.first(_part("path", level * TURN - TURN + DIGEST, TURN - DIGEST))), 16, 10).cast("long").alias("size"), F.first("up").alias("up"), F.first("up_conv").alias("up_conv"),
            F.sum(turns - level + 1).alias("turns"), F.count("*").alias("n_paths"),
        )
        large = ws.save(sizes.filter((F.col("turns") > max_turns) & (F.col("n_paths") > 1)).drop("turns", "n_paths"), f"large{level}")
        if large.isEmpty():
            groups.append(live.withColumn("level", F.lit(level)))
            break
        groups.append(live.join(large.select("key"), "key", "left_anti").withColumn("level", F.lit(level)))
        inside = live.drop("up", "up_conv").join(large.select(F.col("key"), F.col("conv_id").alias("up_conv")), "key").filter(turns > level)
        live = ws.save(inside.select("conv_id", "n_convs", "path", "ends", F.unhex(F.md5(F.concat("key", _part("path", level * TURN, DIGEST)))).alias("key"), F.col("key").alias("up"), "up_conv"), f"live{level}")
        spine.append(large)
    buckets = int(first["turns"] / max_turns) + 1
    dealt = reduce(DataFrame.unionByName, groups).withColumn("bucket", F.pmod(F.xxhash64("level", "key"), F.lit(buckets))).repartition(buckets, "bucket")
    nodes = ws.save(dealt.groupBy("bucket").applyInPandas(build_tries, f"{_NODES}, up binary"), "nodes")
    tops, whole = nodes.filter("up IS NOT NULL"), [nodes.drop("up")]
    for level in range(len(spine) - 1, -1, -1):
        below = tops.filter(F.col("depth") == level + 1).groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("up", "key")
        none = F.lit(0).cast("long")
        done = spine[level].join(below, "key", "left").select(
            "conv_id", F.lit(level).cast("long").alias("depth"), F.col("up_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).alias("n_children"), F.coalesce("n_leaves", none + 1).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("size") + F.coalesce("saved", none)).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "up",
        )
        done = ws.save(done, f"spine{level}")
        tops = tops.unionByName(done)
        whole.append(done.drop("up"))
    return reduce(DataFrame.unionByName, whole)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS pos, d, bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, substring(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d,
               strlen(coalesce(text, ''))::BIGINT AS bytes
        FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), p AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, d, bytes
  FROM (SELECT c.conv_id, o.pos, o.d, o.bytes FROM c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
        UNION ALL SELECT c.conv_id, o.pos, o.d, o.bytes FROM c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h)
), k AS (
  SELECT conv_id, depth, bytes, list(d) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM p UNION ALL SELECT conv_id, 0, 0, [] FROM c
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '') AS ends
  FROM k JOIN (SELECT conv_id, max(depth) AS len FROM k GROUP BY conv_id) USING (conv_id) GROUP BY path, depth
), u AS (
  SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[:n.depth::INTEGER] = n.path) AS n_children, up.conv_id AS parent_conv_id
  FROM n LEFT JOIN n up ON up.depth = n.depth - 1 AND up.path = n.path[: (n.depth - 1)::INTEGER]
), s AS (
  SELECT a.path, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM u JOIN k a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.path
)
SELECT u.conv_id, u.depth::BIGINT AS depth, u.parent_conv_id, u.n_convs, u.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN s USING (path)
"""
