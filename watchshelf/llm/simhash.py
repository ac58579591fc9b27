"""SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint is the majority vote, bit by bit, of the 64-bit hashes of its word shingles. Every bit
position gets a nonzero vector of r + 1 bits; a table for each nonzero v of r + 1 bits keeps the positions whose
vector has an odd product with v. Any r positions leave some v orthogonal to all their vectors, so two fingerprints
that differ in at most r bits agree on all that table's positions: every pair within the radius collides in one of
the 2^(r+1) - 1 tables, none is left to chance.

Equal fingerprints are one node, so exact copies never multiply. A bucket of up to `block` distinct fingerprints is
compared in one task. A larger one is split by the same construction with other vectors: its members agree on the
table's positions, so pairs within the radius differ at no more than r of the others, and some table of the next level
keeps none of these. Each level halves the positions that are still free, so after LEVELS of them a bucket can't have
more than some tens of thousands of distinct members; what is left above `block` then is dealt as pairs of blocks to
separate tasks. All return a spanning forest of the links they find (fewer links than members), which has the same
components as all links.

Defined results: null and wordless texts have fingerprint 0 and link like any other; rows without a doc_id take part
through their fingerprint and get the component of the rows that have one (null if none has); repeated rows are kept;
a very long text is one row of work, in proportion to its words; an empty table gives an empty result. Columns other
than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, per_batch, same, table
from .components import components

BITS, SEED, CHUNK = 64, 42, 1 << 16
#: How often large buckets are split, the first tables included.
LEVELS = 3


def vote(hashes: np.ndarray) -> int:
    """Bit by bit what over half of the hashes have, as an unsigned number; 0 without hashes."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK].astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(data: bytes, size: int = 3) -> int:
    """The vote of all shingles of that many words, as an unsigned number."""
    words = data.lower().split()  # of bytes: A-Z only, and only the six ASCII blanks part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)) if len(words) >= size else [(0, len(joined))]
    return vote(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(spans)))


def _prints(batch: pa.RecordBatch) -> pa.RecordBatch:
    fp = np.array([fingerprint(x or b"") for x in batch.column("data").to_pylist()], np.uint64)
    return pa.RecordBatch.from_pydict({"k": batch.column("k"), "t": batch.column("t"), "fp": pa.array(fp.view(np.int64))})


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k, t (a hash of the text) and fp (as a signed long) for each row of docs."""
    rows = docs.select(docs[key].cast("long").alias("k"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("t"), docs[text].cast("binary").alias("data"))
    return rows.mapInArrow(per_batch(_prints), "k long, t long, fp long")


def masks(radius: int, level: int = 0) -> list[int]:
    """The positions of each table, as signed longs; each level deals other vectors to the positions."""
    count = (1 << (radius + 1)) - 1
    vector = [(i * (1, 11, 23)[level] % 67) % count + 1 for i in range(BITS)]
    unsigned = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, count + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in unsigned]


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as pairs of indices, that connect what pairs within the radius connect; one search over all, no pair twice."""
    left, links = np.arange(len(prints)), ([], [])
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
            if near.any():
                links[0].extend([at] * int(near.sum()))
                links[1].extend(left[near])
                queue.extend(left[near])
                left = left[~near]
    return np.array(links[0], np.int64), np.array(links[1], np.int64)


def _link_runs(radius: int):
    """Over rows sorted by bucket (columns bucket, a, b, fp, node): the links of each run of equal (bucket, a, b)."""

    def links(fp: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(cuts)
        first = cuts[:-1][sizes == 2]
        near = np.bitwise_count(fp[first] ^ fp[first + 1]) <= radius
        out = [(node[first[near]], node[first[near] + 1])]
        for at in np.flatnonzero(sizes > 2):
            x, y = forest(fp[cuts[at] : cuts[at + 1]], radius)
            out.append((node[cuts[at] + x], node[cuts[at] + y]))
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([x for x, _ in out])), "b": pa.array(np.concatenate([y for _, y in out]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("bucket", "a", "b", "fp", "node")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:3]], axis=0)) + 1
            if len(change):
                yield links(held[3].view(np.uint64), held[4], np.concatenate([[0], change]))
                held = [x[change[-1] :] for x in held]
        if held is not None:
            yield links(held[3].view(np.uint64), held[4], np.array([0, len(held[0])]))

    return run


def near_links(prints: DataFrame, ws: Workspace, radius: int = 3, block: int = 1024) -> DataFrame:
    """a, b: links between the nodes of distinct fingerprints (fp, node), complete as to what they connect."""
    rows, dealt = prints.select("fp", "node", F.lit(0).cast("long").alias("held"), F.lit("").alias("way")), []
    for level in range(LEVELS):
        tables = F.array(*[F.struct(F.lit(f"{i} ").alias("i"), F.col("held").bitwiseOR(F.lit(m)).alias("held")) for i, m in enumerate(masks(radius, level))])
        each = rows.select("fp", "node", "way", F.explode(tables).alias("t")).select("fp", "node", F.concat("way", "t.i").alias("way"), "t.held")
        rows = each.withColumn("bucket", F.xxhash64("way", F.col("fp").bitwiseAND(F.col("held"))))
        sizes = ws.save(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), f"sizes{level}")
        last = level + 1 == LEVELS
        own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
        blocks = sizes.filter(F.lit(last) | (F.col("n") <= block)).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        both = rows.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt.append(both.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "node"))
        large = sizes.filter(F.col("n") > block)
        if last or large.isEmpty():
            break
        rows = ws.save(rows.join(large.select("bucket"), "bucket").select("fp", "node", "held", "way"), f"large{level}")
    pairs = dealt[0] if len(dealt) == 1 else reduce(DataFrame.unionAll, dealt)
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = pairs.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "fp")
    return sorted_rows.mapInArrow(_link_runs(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k, t, fp and component, the smallest key that links of at most radius bits reach, for each row of docs."""
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.save(fingerprints(docs, text, key), "prints")
    distinct = ws.save(rows.groupBy("fp").agg(F.min("k").alias("node")), "distinct")
    roots = components(near_links(distinct.filter("node IS NOT NULL"), ws, radius), ws)
    of = ws.save(distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component")), "components")
    return rows.join(of, "fp").select("k", "t", "fp", "component")


def one_of_each(docs: DataFrame, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is the smallest of its component; rows that share that key all stay unless their texts differ.

    Of rows that share the smallest key but not the text, the one whose text hashes lowest stays.
    """
    found = near_duplicates(docs, radius, text, key)
    kept = found.filter(F.col("k").eqNullSafe(F.col("component"))).groupBy("component", F.when(F.col("component").isNull(), F.col("fp"))).agg(F.min(F.struct("k", "t")).alias("s")).select("s.k", "s.t")
    keyed = docs.select(docs[key].alias("k"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("t"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return same(keyed, kept, ["k", "t"], "left_semi").select("row.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
