"""Packing documents into sequences of a fixed number of tokens, by local search over bins.

One pass tokenizes whole texts and leaves slim rows: for each piece of a document its length and the CRC-32 of its ids.
Documents longer than a sequence are cut so that all pieces but the first are full; full pieces are sequences of their
own. The others are dealt by a hash to shards of about `shard` pieces; a task packs its shard best-fit decreasing and
then searches: the emptiest bin moves documents into others, or exchanges one for one, two for one or one for two with
them, always so that the sum of squared fills grows, until it is empty or nothing helps. The emptiest bins of all shards
are then dealt to an eighth as many and searched again, round after round, until one shard holds them or all bins have
less room together than one sequence (then no packing is better).

Ids are those of the tokenizers library. tiktoken gets them from the same vocabulary in a third of the time, but knows
no special tokens and can't match very long runs of white space; texts with either go to tokenizers.

Defined results: null text is empty and has the end token alone; rows with a null or repeated key are documents of
their own; equal lengths are packed in the order of the rows; a very long text is one row of work, linear in its length; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

SIZE, END = 1024, 2
#: Pieces that a task packs; a shard leaves a few bins with room, which later rounds fill.
SHARD = 4_000


def encoder(vocabulary: str, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids; ranks: the same vocabulary as a file of tiktoken's."""
    from tokenizers import Tokenizer

    plain = None
    if ranks:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    whole = Tokenizer.from_file(vocabulary)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    blank = re.compile(r"\s{10000}")

    def encode(text: str) -> np.ndarray:
        if plain is None or any(s in text for s in special) or (len(text) > 10_000 and blank.search(text)):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return plain.encode_to_numpy(text, disallowed_special=())

    return encode


def pieces_of(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """start and length of the pieces of n tokens; the first takes what the full ones leave."""
    first = (n - 1) % size + 1
    return [(0, first), *((at, size) for at in range(first, n, size))]


def tokenized(docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = SIZE, end: int = END, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece of each document, with its ids (little-endian, 32 bits each) if asked for."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows, at = [], []
            for i, x in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(x or ""), np.uint32(end)).astype("<u4", copy=False)
                for k, (start, length) in enumerate(pieces_of(len(ids), size)):
                    own = ids[start : start + length].tobytes()
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(own), own if keep_ids else None))
            names = ["piece", "start", "length", "ids_crc32", "ids"]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at, pa.int64())), *columns], ["k", *names])

    found = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text")).mapInArrow(cut, f"k {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return found if keep_ids else found.drop("ids")


class Bins:
    """Bins of lengths, and what those with room could give away: one or two of their documents, by room and by sum of lengths.

    Sets of sums are the bits of an integer, so the best exchange among all bins of a room is found by a shift.
    """

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.held: list[list[int]] = []
        self.room: list[int] = []
        self.open: list[dict[int, None]] = [{} for _ in range(size + 1)]  # bins by room
        self.rooms = 0  # bits
        self.offers: tuple = tuple([defaultdict(dict) for _ in range(size + 1)] for _ in range(2))  # one or two documents: by room, by sum: bins
        self.sums = [[0] * (size + 1) for _ in range(2)]  # bits of these sums

    def _ways(self, b: int) -> Iterator[tuple[int, int]]:
        """How many documents (0: one, 1: two) and their sum, for all that a bin could give."""
        seen = sorted(own := [self.lengths[i] for i in self.held[b]])
        single = sorted(set(own))
        for x in single:
            yield 0, x
        twice = {x for x, y in zip(seen, seen[1:], strict=False) if x == y}
        for s in {x + y for k, x in enumerate(single) for y in single[k + 1 :]} | {2 * x for x in twice}:
            yield 1, s

    def _list(self, b: int, on: bool) -> None:
        if not (r := self.room[b]):
            return
        if on:
            self.open[r][b] = None
            self.rooms |= 1 << r
            for w, s in self._ways(b):
                self.offers[w][r][s][b] = None
                self.sums[w][r] |= 1 << s
        else:
            del self.open[r][b]
            if not self.open[r]:
                self.rooms &= ~(1 << r)
            for w, s in self._ways(b):
                at = self.offers[w][r][s]
                del at[b]
                if not at:
                    self.sums[w][r] &= ~(1 << s)

    def add(self, items: list[int]) -> int:
        self.held.append(items)
        self.room.append(self.size - sum(self.lengths[i] for i in items))
        return len(self.held) - 1

    def best_fit(self, items: list[int]) -> None:
        """Puts each item, the longest first, into the fullest bin with room for it; before search()."""
        for i in sorted(items, key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            if fits := self.rooms >> n:
                r = n + (fits & -fits).bit_length() - 1
                b, _ = self.open[r].popitem()
                if not self.open[r]:
                    self.rooms &= ~(1 << r)
                self.held[b].append(i)
                self.room[b] -= n
            else:
                b = self.add([i])
            if r := self.room[b]:
                self.open[r][b] = None
                self.rooms |= 1 << r

    def _swap(self, weak: int, given: list[int], b: int, taken: list[int]) -> None:
        self._list(b, False)
        for i in given:
            self.held[weak].remove(i)
        for i in taken:
            self.held[b].remove(i)
        self.held[b] += given
        self.held[weak] += taken
        moved = sum(self.lengths[i] for i in given) - sum(self.lengths[i] for i in taken)
        self.room[b] -= moved
        self.room[weak] += moved
        self._list(b, True)

    def _pick(self, b: int, n: int, s: int) -> list[int]:
        """Items of bin b, n of them, with sum s."""
        by = {}
        for i in self.held[b]:
            if n == 1 and self.lengths[i] == s:
                return [i]
            if n == 2 and (j := by.get(s - self.lengths[i])) is not None:
                return [j, i]
            by[self.lengths[i]] = i
        raise AssertionError("a listed offer is there")

    def _step(self, weak: int) -> bool:
        """The action on the weak bin, which isn't listed, that adds most to the sum of squared fills; a move first."""
        mine = self.room[weak]
        for i in sorted(self.held[weak], key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            if (fits := self.rooms >> n) and (r := n + (fits & -fits).bit_length() - 1) < mine + n:
                self._swap(weak, [i], next(iter(self.open[r])), [])
                return True
        best, ways, r = (0,), list(self._ways(weak)), self.rooms
        while r:
            room = (r & -r).bit_length() - 1
            r &= r - 1
            if room * mine <= best[0]:
                continue  # no bin of this room gains so much
            for own, s in ways:
                for other in (0, 1) if own == 0 else (0,):
                    low = max(s - room, 1)
                    if fits := self.sums[other][room] >> low:
                        gain = s - low - (fits & -fits).bit_length() + 1
                        # half of what the squares grow by
                        if gain > 0 and (grown := gain * (mine - room + gain)) > best[0]:
                            best = (grown, room, gain, own, s, other)
        if not best[0]:
            return False
        _, room, gain, own, s, other = best
        b = next(iter(self.offers[other][room][s - gain]))
        self._swap(weak, self._pick(weak, own + 1, s), b, self._pick(b, other + 1, s - gain))
        return True

    def search(self) -> None:
        """Acts until nothing increases the sum of squared fills, or the room of all is less than one bin."""
        self.open, self.rooms = [{} for _ in range(self.size + 1)], 0
        for b in range(len(self.held)):
            if self.held[b]:
                self._list(b, True)
        spare = sum(r for b, r in enumerate(self.room) if self.held[b])
        acted = True
        while acted and spare >= self.size:
            acted = False
            for weak in sorted((b for b in range(len(self.held)) if self.held[b] and self.room[b]), key=lambda b: -self.room[b]):
                if spare < self.size:
                    break
                if not self.room[weak]:
                    continue  # filled meanwhile
                self._list(weak, False)
                while self.held[weak] and self._step(weak):
                    acted = True
                if self.held[weak]:
                    self._list(weak, True)
                else:
                    spare -= self.size


def packed(lengths: list[int], bins: list | None = None, size: int = SIZE) -> list[list[int]]:
    """Indices of lengths by bin. bins: a bin for each, None for what is in none yet."""
    own = Bins(lengths, size)
    given: dict = {}
    for i, b in enumerate(bins or ()):
        if b is not None:
            given.setdefault(b, []).append(i)
    for items in given.values():
        own.add(items)
    own.best_fit([i for i in range(len(lengths)) if not bins or bins[i] is None])
    own.search()
    return [x for x in own.held if x]


def _pack_shard(size: int) -> Callable[[pa.Table], pa.Table]:
    def pack(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("item")
        lengths, items = shard["length"].to_pylist(), shard["item"].to_pylist()
        bins, offset, fill = [0] * len(items), [0] * len(items), [0] * len(items)
        for held in packed(lengths, shard["bin"].to_pylist(), size):
            at, name = 0, min(items[i] for i in held)
            for i in sorted(held):
                bins[i], offset[i] = name, at
                at += lengths[i]
            for i in held:
                fill[i] = at
        for c, x in (("bin", bins), ("offset", offset), ("fill", fill)):
            shard = shard.set_column(shard.schema.get_field_index(c), pa.field(c, pa.int64()), pa.array(x, pa.int64()))
        return shard

    return pack


def pack(pieces: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """pieces (length, of size at most) with sequence_id and offset; the columns item, bin and fill are for use inside."""
    ws = Workspace(pieces.sparkSession, "packing")
    none = F.lit(None).cast("long")
    rows = ws.save(pieces.withColumns({"item": F.monotonically_increasing_id(), "bin": none, "offset": none, "fill": none}), "pieces")
    full = F.col("length") == size
    done = [rows.filter(full).withColumns({"bin": F.col("item"), "offset": F.lit(0).cast("long")})]
    live = rows.filter(~full)
    shards, k = -(-live.count() // shard), 0
    while True:
        dealt = live.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("bin", "item"), F.lit(k)), F.lit(max(1, shards)))).repartition(max(1, shards), "shard")
        now = ws.save(dealt.groupBy("shard").applyInArrow(_pack_shard(size), dealt.schema).drop("shard"), f"round{k}")
        # a bin's first row stands for the bin; one row for each fill
        fills = now.groupBy("fill").agg(F.count("*").alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).collect() if shards > 1 else []
        fewer, least, held = -(-shards // 8), None, 0
        for r in sorted(fills):
            if (held := held + r["n"]) > fewer * shard:
                break
            least = r["fill"]
        if least is None or sum((size - r["fill"]) * r["bins"] for r in fills) < size:
            done.append(now)
            break
        done.append(now.filter(F.col("fill") > least))
        live, shards, k = now.filter(F.col("fill") <= least), fewer, k + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("bin", "sequence_id").drop("item", "fill")


def sequences(packs: DataFrame, end: int = END) -> DataFrame:
    """sequence_id, n_tokens and ids (one after the other, 32 bits each) of pieces with their ids, as pack() gives them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packs.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(parts, lambda x: x["ids"]), "")).alias("ids"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pack(pieces).withColumnRenamed("k", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
