"""Near-dedup by the Jaccard similarity of word shingles: every pair at or above the threshold is found.

Two sets with Jaccard similarity of at least s share one of the first n - ceil(s * n) + 1 members (n: the set's size) in
any order of all members that is the same for both. So texts are looked up by these prefixes, and what is found is
compared exactly, set by set: no pair is left to chance. The order puts members that are common in a sample last, which
keeps hot members out of the prefixes and has no bearing on the result. What two sets of n and m members must share, o
of them, they share from the first n - o + 1 and m - o + 1 on; so of two sets the smaller one is looked up by fewer of
its members, and pairs whose shared member comes too late are never made. Of pairs that are left the sketches are
compared: for each of a few slots for a member whether it holds an odd number of the set's. A member that only one of two
sets has changes one slot, so where more slots differ than alike sets may have members apart, the pair isn't alike. A
sketch takes a sixteenth of the bytes of its set at most (eight bytes at least), and only what it leaves open is compared
set by set.

Texts of equal sets are one node. First come the links that op3's operator finds among the texts' fingerprints (SimHash on
these shingles, three bits, covering masks), compared exactly; they tie most copies together. Fingerprints of sets that are
just alike enough differ in about ten bits, so the prefixes then find the rest. In each prefix member's group all nodes are first compared with a representative, the
one that has the member earliest: an original, which edits have not given rare members, comes before its copies. What
is alike is joined into components. While groups still hold many pairs of different components, and each pass
leaves clearly fewer, further passes compare them with other representatives, so that near copies hardly ever meet pair by
pair, not even those that are like some of their group and unlike others. Then the remaining pairs of different
components are compared, so what is connected in the end is what all pairs would connect.

What is shuffled goes in slices, one after the other: members by their hash, texts by theirs, pairs by their larger set, in as
many slices as their bytes ask for. So disk holds the prefixes and one slice, however much faster than the texts the pairs grow.

Defined results: words are parted at ASCII blanks, A-Z lower-cased; texts of fewer words than a shingle are one shingle;
null and wordless texts are alike; a row without a key goes where a row with one is alike, repeated rows are kept; an
empty table gives an empty result. Other columns are carried along in one struct, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, per_batch, same, setting
from .components import components
from .simhash import SEED, near_links, vote

#: The sample for the order of members, and how many common ones it may name; neither changes a result.
SAMPLE, COMMON = 5_000, 100_000
REPRESENTATIVES = 4
#: How many common members a pair must have to be looked at, where their number of members leaves that open.
AT_LEAST = 3
#: Entries and texts are shuffled in so many slices at most, and pairs in as many as keep a slice to this part of the bytes of all sets; ROOM_BYTES are one slice.
SLICES, ROOM, ROOM_BYTES = 4, 0.2, 64_000_000
#: Bytes of a pair while it is counted.
PAIR_BYTES = 24
#: From which size of a table on, and up to which size of the other, Spark drops its rows by a Bloom filter of the other's keys before they are shuffled.
_FILTER_FROM, _FILTER_BY = (f"spark.sql.optimizer.runtime.bloomFilter.{x}Threshold" for x in ("applicationSideScanSize", "creationSide"))
#: Pairs of different components in all groups, for each entry of a group, that are compared without another pass.
PAIRS_AT_ONCE = 2


def runs(data: bytes, size: int) -> np.ndarray:
    """The hashes of all runs of that many words, repeats included; their vote is the fingerprint of simhash.py."""
    words = data.lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1) if words else 0)), np.uint64)


def shingles(data: bytes, size: int) -> np.ndarray:
    """The sorted distinct ones."""
    return np.unique(runs(data, size))


def prefix(members: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members in the order of rank (0 for those that are not in common), then of the hash."""
    if not len(members):
        return members
    n = len(members) - math.ceil(similarity * len(members) - 1e-9) + 1
    if not len(common):
        return members[:n]
    at = np.minimum(np.searchsorted(common, members), len(common) - 1)
    return members[np.lexsort((members, np.where(common[at] == members, rank[at], 0)))[:n]]


def sketch(members: np.ndarray) -> bytes:
    """A bit for each slot: whether it holds an odd number of the distinct members. Slots are a power of two, two to four for a member."""
    slots = max(64, 1 << (2 * len(members)).bit_length())
    held = np.bincount((members & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits(held & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many slots two sketches differ, of the fewer slots of the two: at most as many as members are in one of the sets only."""
    a, b = sorted((np.frombuffer(z, np.uint8) for z in (x, y)), key=len)
    while len(a) < len(b):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _text_hash(docs: DataFrame, text: str):
    return F.xxhash64(F.coalesce(docs[text], F.lit("")))


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common members in a sample of the texts, sorted, and their counts."""
    every = max(1, texts.count() // SAMPLE)

    def members(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"s": pa.array(np.concatenate([shingles(x or b"", size) for x in batch.column("data").to_pylist()]).view(np.int64))})

    sample = texts.filter(F.pmod("t", F.lit(every)) == 0).select("data").mapInArrow(per_batch(members), "s long")
    found = sample.groupBy("s").count().filter("count > 5").orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    members, count = found["s"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(members)
    return members[order], count[order]


def _indexed(similarity: float, which: int = 1):
    """Whether an entry may be one of the first so many that a set shares with one of at least its own size."""
    return F.col("n") - F.col("pos") >= F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6 - (which - 1)


def _crossing(entry: DataFrame, similarity: float) -> int:
    """How many pairs of nodes of different components the groups hold."""
    parts = entry.filter(_indexed(similarity)).groupBy("s", "root").agg(F.count("*").alias("c")).groupBy("s").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("own"))
    return int(parts.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2)).first()[0] or 0)


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, links)


def _sliced(ws: Workspace, name: str, slices: int, make: Callable[[int], DataFrame]) -> DataFrame:
    """All that make returns for the slices, saved one after the other, so that only one slice's shuffle files exist at a time."""
    return _all([ws.save(make(i), f"{name}/slice{i}") for i in range(slices)])


def _in(column: str, slices: int, i: int) -> Column:
    """Whether a row is in that slice of them."""
    return F.pmod(F.xxhash64(F.lit("slice"), column), F.lit(slices)) == i


def groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k, t (a hash of the text) and root, one number for all that links of that similarity connect, for each row of docs."""
    ws = Workspace(docs.sparkSession, "similar")
    texts = docs.select(docs[key].cast("long").alias("k"), _text_hash(docs, text).alias("t"), docs[text].cast("binary").alias("data"))
    common, rank = _common(texts, size)

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [runs(x or b"", size) for x in batch.column("data").to_pylist()]
        sets = [np.unique(x) for x in hashes]
        node = pa.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], pa.uint64()).to_numpy().view(np.int64)
        prints = pa.array([vote(x) for x in hashes], pa.uint64()).to_numpy().view(np.int64)
        heads = pa.array([prefix(x, similarity, common, rank).view(np.int64) for x in sets], pa.list_(pa.int64()))
        n, sketches = pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())
        return pa.RecordBatch.from_pydict({"k": batch.column("k"), "t": batch.column("t"), "node": pa.array(node), "fp": pa.array(prints), "n": n, "sketch": sketches, "head": heads})

    read = ws.save(texts.mapInArrow(per_batch(prefixes), "k long, t long, node long, fp long, n long, sketch binary, head array<long>"), "read")
    of_a_row = [F.first(c).alias(c) for c in ("fp", "n", "sketch", "head")]
    heads = ws.save(read.groupBy("node").agg(F.min(F.struct("k", "t")).alias("at"), *of_a_row), "heads")
    nodes = ws.save(heads.drop("head"), "nodes")
    rows = ws.save(read.select("k", "t", "node"), "rows")
    ws.drop("read")
    all_sets, all_sketches = (x or 0 for x in nodes.agg(8 * F.sum("n"), F.sum(F.octet_length("sketch") + PAIR_BYTES)).first())
    room, even = max(ROOM_BYTES, ROOM * all_sets), max(1, min(SLICES, math.ceil(all_sets / ROOM_BYTES)))
    least = F.min_by(F.struct("node", "n", "pos"), F.struct("pos", F.xxhash64("node")))

    def shared(i: int) -> DataFrame:
        entries = heads.select("node", "n", F.posexplode("head").alias("pos", "s")).filter(_in("s", even, i))
        return entries.join(entries.groupBy("s").agg(F.count("*").alias("many"), least.alias("rep")).filter("many > 1").select("s", "rep"), "s")

    met = _sliced(ws, "met", even, shared)
    ws.drop("heads")
    # what the sets of a pair must share, and whether a member that they share comes early enough in both
    overlap = (F.col("n") + F.col("n2")) * (similarity / (1 + similarity)) - 1e-6
    early = (F.col("n") - F.col("pos") >= overlap) & (F.col("n2") - F.col("pos2") >= overlap)

    def possible(both: DataFrame, name: str) -> DataFrame:
        """Those of the distinct pairs (a, b) whose sketches differ in no more slots than alike ones may."""
        own = lambda a, n, x: nodes.select(F.col("node").alias(a), F.col("n").alias(n), F.col("sketch").alias(x))
        sizes = nodes.select(F.col("node").alias("a"), F.octet_length("sketch").alias("size"))
        # of a pair and of all nodes on both sides of it
        slices = math.ceil((2 * all_sketches + 2 * (both.join(sizes, "a").agg(F.sum(F.col("size") + PAIR_BYTES)).first()[0] or 1)) / room)

        def near(batch: pa.RecordBatch) -> pa.RecordBatch:
            most = (batch.column("n").to_numpy() + batch.column("n2").to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            return batch.select(["a", "b"]).filter(pa.array(np.array([apart(x, y) for x, y in both]) <= most))

        def near_ones(i: int) -> DataFrame:
            sketched = both.filter(_in("a", slices, i)).join(own("a", "n", "x").filter(_in("a", slices, i)), "a").join(own("b", "n2", "y"), "b")
            return sketched.select("a", "b", "n", "n2", "x", "y").mapInArrow(per_batch(near), "a long, b long")

        found = _sliced(ws, f"{name}-pairs", slices, near_ones)
        ws.drop(f"{name}-both")
        return found

    def links(both: DataFrame, name: str) -> DataFrame:
        """Those of the distinct pairs (a, b), which are saved as name-both, that are alike."""
        pairs = possible(both, name)
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "at.k", "at.t"), "node")
        asked = ws.save(asked, f"{name}-asked")

        def members(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": batch.column("node"), "members": pa.array([shingles(x or b"", size).tobytes() for x in batch.column("data").to_pylist()], pa.binary())})

        def sets_of(i: int) -> DataFrame:
            found = same(texts.filter(_in("t", even, i)), asked.filter(_in("t", even, i)), ["k", "t"], "inner").dropDuplicates(["node"]).select("node", "data")
            return found.mapInArrow(per_batch(members), "node long, members binary")

        with setting(ws.spark, _FILTER_FROM, "0"), setting(ws.spark, _FILTER_BY, "100MB"):  # few of all texts are looked up
            sets = _sliced(ws, f"{name}-sets", even, sets_of)

        def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            yes = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in both], pa.bool_())
            return batch.select(["a", "b"]).filter(yes)

        x, y = (sets.select(F.col("node").alias(c), F.col("members").alias(m)) for c, m in (("a", "x"), ("b", "y")))
        slices = math.ceil((pairs.join(nodes.select(F.col("node").alias("a"), "n"), "a").agg(F.sum(F.col("n") * 8 + PAIR_BYTES)).first()[0] or 1) / room)

        def alike_ones(i: int) -> DataFrame:
            with_sets = pairs.filter(_in("a", slices, i)).join(x.filter(_in("a", slices, i)), "a").join(y, "b")
            return with_sets.select("a", "b", "x", "y").mapInArrow(per_batch(compared), "a long, b long")

        linked = _sliced(ws, f"{name}-links", slices, alike_ones)
        ws.drop(f"{name}-pairs", f"{name}-asked", f"{name}-sets")
        return linked

    def by_prints() -> DataFrame:
        """Pairs of nodes whose fingerprints are within three bits: links that connect all such fingerprints, and each node with the one that stands for its own."""
        prints = ws.save(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
        near = near_links(prints.select("fp", F.col("rep").alias("node")), Workspace(ws.spark, "similar-prints"))
        return near.unionAll(nodes.join(prints, "fp").filter("node != rep").select("node", "rep"))

    def ordered(pairs: DataFrame) -> DataFrame:
        """Distinct, as a > b."""
        return pairs.toDF("x", "y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    stars = met.filter("node != rep.node").select("node", "n", "pos", *[F.col(f"rep.{c}").alias(f"{c}2") for c in ("node", "n", "pos")])
    first = links(ws.save(ordered(by_prints().unionAll(stars.filter(early).select("node", "node2"))), "first-both"), "first")
    roots = ws.save(components(first, ws), "first-roots")
    entry = ws.save(met.join(roots, "node", "left").select("s", "node", "n", "pos", F.coalesce("root", "node").alias("root")), "entries0")
    ws.drop("met")
    left, links_found, k = _crossing(entry, similarity), [first], 0
    while left > PAIRS_AT_ONCE * entry.count():
        k += 1
        least = F.min_by(F.struct("node", "n", "pos", "root"), F.xxhash64("node", F.pmod("s", F.lit(REPRESENTATIVES)), F.lit(k)))
        reps = entry.groupBy("s").agg(least.alias("rep"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("s", "rep")
        stars = entry.join(reps, "s").filter("root != rep.root").select("node", "n", "pos", *[F.col(f"rep.{c}").alias(f"{c}2") for c in ("node", "n", "pos")])
        links_found.append(links(ws.save(ordered(stars.filter(early).select("node", "node2")), f"pass{k}-both"), f"pass{k}"))
        roots = ws.save(components(_all(links_found), Workspace(ws.spark, f"similar-pass{k}")), f"roots{k}")
        entry = ws.save(entry.drop("root").join(roots, "node", "left").select("s", "node", "n", "pos", F.coalesce("root", "node").alias("root")), f"entries{k}")
        ws.drop(f"entries{k - 1}")
        left, before = _crossing(entry, similarity), left
        if left > 0.7 * before:
            break
    right = entry.filter(_indexed(similarity, AT_LEAST)).select("s", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "root")])
    # of what a pair must share, the first members, as many as fit into both prefixes, AT_LEAST at most
    need = F.greatest(F.lit(1), F.least(F.lit(AT_LEAST), F.ceil(overlap) - F.ceil(F.col("n") * similarity - 1e-9) + 1))
    among_first = (F.col("n") - F.col("pos") >= overlap - need + 1) & (F.col("n2") - F.col("pos2") >= overlap - need + 1)
    slices = math.ceil((left + 1) * PAIR_BYTES / room)

    def crossing(i: int) -> DataFrame:
        larger = entry.filter(_in("node", slices, i))
        rest = larger.join(right, (larger["s"] == right["s"]) & (F.col("root") != F.col("root2")) & (F.struct("n", "node") > F.struct("n2", "node2")) & among_first)
        counted = rest.groupBy("node", "node2").agg(F.count("*").alias("c"), F.first(need).alias("need"))
        return counted.filter("c >= need").select(F.col("node").alias("a"), F.col("node2").alias("b"))

    second = links(_sliced(ws, "second-both", slices, crossing), "second")
    ws.drop("nodes")
    ws.drop(f"entries{k}")
    final = components(_all([*links_found, second]), Workspace(ws.spark, "similar-final"))
    return rows.select("k", "t", "node").join(final, "node", "left").select("k", "t", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is the smallest of its group; of rows that share it, those with the text that hashes lowest."""
    found = groups(docs, similarity, size, text, key)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "t")).alias("s")).select("s.k", "s.t")
    keyed = docs.select(docs[key].alias("k"), _text_hash(docs, text).alias("t"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return same(keyed, kept, ["k", "t"], "left_semi").select("row.*")
