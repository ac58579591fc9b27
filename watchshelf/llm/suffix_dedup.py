"""Suffix-array dedup: every byte covered by a long string that also starts in a document with a smaller doc_id goes.

A string of `length` bytes has length - PREFIX + 1 suffixes that start in it with PREFIX bytes of their own; the one
whose hash is lowest is sampled, so two equal strings sample the same suffix at the same place, and about a fourteenth
of all suffixes are kept: no match is lost by that. Batches of documents (by doc_id) get sparse suffix arrays: the sampled
suffixes in byte order of their first PREFIX bytes, dealt into parts by a hash of these. The index is a logarithmic family:
a new batch's array is merge-scanned against every level for suffixes that share all PREFIX bytes with one of an earlier
document, then it merges with the levels of its own size, as in a binary counter, so n batches leave at most log2(n) + 1 levels.

The hits are candidates, and exact extension to both sides settles them. Around each, the text of the strings that sample it
is sent to the part of its beginning, once for each slot of documents; there all strings of `length` bytes are grouped by
a hash, compared byte by byte with the first of their group, and the smallest doc_id that has a string decides for all
others. A beginning with many different surroundings (HOT or more, counted once in each slot) would pile up in one part,
so its strings are cut into single ones, and each goes to the part of its own hash. Slots (about slot_bytes of text each) ask
and are answered in the order of their own sorted arrays, so answers are a bit for each question. No step holds more than one
slot or one part in memory, and a string that millions of documents share is one entry for each slot.

Defined results: null text is empty; documents shorter than `length` lose nothing; rows with equal doc_id don't remove
from each other; a null doc_id counts as larger than all others; repeated rows each get the same result; a very long text is
one slot's, scanned in overlapping pieces; empty tables give empty results. Columns other than key and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

PREFIX = 24
SLOT_BYTES, PART_BYTES, CHUNK = 5_000_000, 3_000_000, 1_000_000
#: Parts are indexed in so many ranges, one after the other, so that disk holds the levels and shuffle files of one.
RANGES = 2
#: From so many different surroundings on a beginning's strings are dealt one by one.
HOT = 1000
LAST = (1 << 63) - 1
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(data: bytes) -> np.ndarray:
    """A well-mixed number for the eight bytes from each position on; data ends in eight bytes that don't count."""
    x = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,)) * ODD[0]
    x ^= x >> np.uint64(29)
    x *= ODD[1]
    x ^= x >> np.uint64(32)
    return x


def _hashed(mixed: np.ndarray, at: np.ndarray | slice, length: int, salt: int) -> np.ndarray:
    """The hash of that many bytes from each position on (a slice: from 0)."""
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    out: np.ndarray | None = None
    for i, step in enumerate(steps):
        part = (mixed[step : len(mixed) - length + 8 + step] if isinstance(at, slice) else mixed[at + step]) * ODD[(i + salt) % 8]
        if i:
            part ^= part >> np.uint64(31)  # so that the order of the parts counts
        out = part if out is None else out + part
    out ^= out >> np.uint64(33)
    out *= ODD[(salt + 3) % 8]
    return out


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of that width."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def _chunks(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts, or overlapping pieces of very long ones, as (text, offset, bytes), gathered up to about CHUNK bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _places(sizes: np.ndarray, length: int) -> np.ndarray:
    """Where strings of that length start in texts of these sizes, one after the other."""
    ends = np.cumsum(sizes)
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
    np.add.at(step, ends - sizes, 1)
    np.add.at(step, ends - length + 1, -1)
    return np.flatnonzero(np.cumsum(step, dtype=np.int8))


def packed_keys(keys: np.ndarray) -> bytes:
    """Rows of three numbers as PREFIX bytes each, most significant first, compressed; their number comes first."""
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(keys.astype(">u8").tobytes(), asbytes=True)


def unpacked_keys(data: bytes) -> np.ndarray:
    whole = pa.Codec("zstd").decompress(data[8:], PREFIX * int.from_bytes(data[:8], "little"), asbytes=True)
    return np.frombuffer(whole, ">u8").astype(np.uint64).reshape(-1, 3)


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _spans(found: list[tuple]) -> bytes:
    """Text, first and last string of each piece, column by column."""
    return _shrunk(np.array([x[:3] for x in found], "<i4").reshape(-1, 3).T.tobytes())


def _read_spans(data: bytes) -> np.ndarray:
    return np.frombuffer(_grown(data), "<i4").reshape(3, -1).astype(np.int64)


def in_order(keys: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The order of rows of keys: by one number (first, or their first eight bytes), then where that is equal by all bytes."""
    lead = keys[:, 0] if first is None else first
    order = np.argsort(lead)
    sorted_lead = lead[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_lead[1:] != sorted_lead[:-1]
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    if len(tied):
        group, rows = np.cumsum(new)[tied], keys[order[tied]]
        order[tied] = order[tied[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], group))]]
    return order


def shares_prefix(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, whether each has all PREFIX bytes in common with the one before it."""
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:, 0] == keys[:-1, 0]) & (keys[1:, 1] == keys[:-1, 1]) & (keys[1:, 2] == keys[:-1, 2])
    return same


def distinct_keys(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = keys[in_order(keys)]
    return keys[~shares_prefix(keys)]


def found_in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of keys is among the known ones: one merged sequence in byte order, scanned for equal neighbours."""
    both = np.concatenate([known, keys])
    out = np.zeros(len(both), bool)
    if len(both):
        order = in_order(both)
        start = np.flatnonzero(~shares_prefix(both[order]))
        of_known = np.logical_or.reduceat(order < len(known), start)
        out[order] = np.repeat(of_known, np.diff(np.append(start, len(order))))
    return out[len(known) :]


NONE = np.zeros((0, 3), np.uint64)


class Runs:
    """The sampled suffixes of some texts in byte order within each part: each with its first bytes and the run of string starts that sample it."""

    def __init__(self, texts: list[bytes], length: int, parts: int, counted: bool = False):
        """counted: also how many different surroundings each beginning has (kinds)."""
        found = [self._runs(c, length, counted) for c in _chunks(texts, length)] or [(np.zeros(0, np.uint64), NONE, np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))]
        hashed, prefix, around, self.text, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True))
        part = (hashed & LOW) % np.uint64(parts)
        width = np.uint64(max(1, parts.bit_length()))
        self.order = in_order(prefix, part << (np.uint64(64) - width) | prefix[:, 0] >> width)
        prefix, part, text = prefix[self.order], part[self.order].astype(np.int64), self.text[self.order]
        new = ~shares_prefix(prefix)
        new[1:] |= part[1:] != part[:-1]
        starts = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1  # of each run in order
        self.keys, self.parts = prefix[starts], part[starts]
        self.shared = np.maximum.reduceat(text, starts) != np.minimum.reduceat(text, starts) if len(starts) else np.zeros(0, bool)
        self.kinds = np.ones(len(starts), np.int64)
        if counted:
            several = np.flatnonzero(~(new & np.append(new[1:], True)))  # runs whose beginning has more than one
            entry, around = self.entry[several], around[self.order[several]]
            order = np.lexsort((around, entry))
            entry, around = entry[order], around[order]
            other = np.ones(len(entry), bool)
            other[1:] = (entry[1:] != entry[:-1]) | (around[1:] != around[:-1])
            found_entries, counts = np.unique(entry[other], return_counts=True)
            self.kinds[found_entries] = np.minimum(counts, 65_535)

    @staticmethod
    def _runs(chunk: list[tuple[int, int, bytes]], length: int, counted: bool) -> tuple[np.ndarray, ...]:
        """Hash and first bytes of the sampled suffix, a hash of the text around it, the text, the first and the last start."""
        sizes = np.array([len(p) for *_, p in chunk])
        data = b"".join(p for *_, p in chunk) + bytes(8 + PREFIX)
        mixed = _mixed(data)
        key = _hashed(mixed, slice(None), PREFIX, 0)
        lowest = _lowest(key & HIGH | np.arange(len(key), dtype=np.uint64), length - PREFIX + 1)
        place = _places(sizes, length)
        anchor = (lowest[place] & LOW).astype(np.int64)
        cut = np.ones(len(place), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(place)) - 1
        offsets = np.cumsum(sizes) - sizes
        piece = np.searchsorted(offsets, place[starts], side="right") - 1
        shift = np.array([at for _, at, _ in chunk]) - offsets
        anchor, first, last = anchor[starts], place[starts], place[ends]
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        prefix = np.stack([words[anchor + i].byteswap() for i in range(0, PREFIX, 8)], 1)
        # the first and the last string cover all that is around a suffix
        around = _hashed(mixed, first, length, 1) * ODD[5] ^ _hashed(mixed, last, length, 2) + (last - first).astype(np.uint64) * ODD[6] if counted else np.zeros(len(first), np.uint64)
        return key[anchor], prefix, around, np.array([i for i, *_ in chunk])[piece], first + shift[piece], last + shift[piece]

    def by_part(self) -> Iterator[tuple[int, slice]]:
        if not len(self.parts):  # all texts are shorter than `length`
            return
        cuts = np.flatnonzero(np.append(True, self.parts[1:] != self.parts[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(self.parts)], strict=True):
            yield int(self.parts[a]), slice(a, b)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _sorted_texts(slot: pa.Table) -> tuple[list[int], list[bytes], list[int | None]]:
    """Keys (null: the largest), texts and keys as they are, in the order of key and text, whatever order the rows came in."""
    rows = [(LAST if k is None else k, d or b"", k) for k, d in zip(slot.column("k").to_pylist(), slot.column("data").to_pylist(), strict=True)]
    rows.sort(key=lambda r: r[:2])
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


class Candidates:
    """The distinct strings around the candidates of a slot, in the order in which they are sent; marked: for each part the bits of its keys that hit, then of those that are hot."""

    def __init__(self, keys: list[int], texts: list[bytes], runs: Runs, marked: dict[int, bytes], length: int, parts: int):
        hit, hot = np.zeros(len(runs.keys), bool), np.zeros(len(runs.keys), bool)
        for part, own in runs.by_part():
            if part in marked:
                n = own.stop - own.start
                bits = _bits(marked[part], 2 * n)
                hit[own], hot[own] = bits[:n], bits[n:]
        chosen = np.flatnonzero(hit[runs.entry])
        entry = runs.entry[chosen]
        chosen = runs.order[chosen]
        by_run = np.lexsort((chosen, runs.parts[entry]))  # in each part by document, so that the smallest comes first
        owners: dict[bytes, int] = {}
        self.sent: dict[int, list[tuple[int, int, int, bytes]]] = {}
        self.settled: list[tuple[int, int, int]] = []

        def add(i: int, first: int, last: int, piece: bytes, part: int) -> None:
            if owners.setdefault(piece, keys[i]) < keys[i]:
                self.settled.append((i, first, last))
            else:
                self.sent.setdefault(part, []).append((i, first, last, piece))

        whole: dict[bytes, int] = {}
        for run, part, alone in zip(chosen[by_run].tolist(), runs.parts[entry][by_run].tolist(), hot[entry][by_run].tolist(), strict=True):
            i, first, last = int(runs.text[run]), int(runs.first[run]), int(runs.last[run])
            piece = texts[i][first : last + length]
            if not alone:
                add(i, first, last, piece, part)
            elif whole.setdefault(piece, keys[i]) < keys[i]:
                self.settled.append((i, first, last))
            else:
                for at in range(first, last + 1):
                    one = texts[i][at : at + length]
                    add(i, at, at, one, zlib.crc32(one) % parts)


def _message(**columns) -> pa.Table:
    kinds = {"slot": pa.int64(), "part": pa.int64(), "n": pa.int64()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.string() if k == "kind" else pa.binary())) for k, v in columns.items()})


def confirm(data: bytes, at: np.ndarray, starts: np.ndarray, group: np.ndarray, owner: np.ndarray, later: np.ndarray, order: np.ndarray, length: int) -> None:
    """Compares the strings that are to go byte by byte with one of the smallest owner in their group; where hashes collided, decides anew by the bytes.

    All but later are in the order of groups.
    """
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    owns = owner == np.minimum.reduceat(owner, starts)[group]
    least = np.minimum.reduceat(np.where(owns, np.arange(len(owner)), len(owner)), starts)
    going = np.flatnonzero(later[order])
    equal = np.ones(len(going), bool)
    for k in range(0, len(going), 1_000_000):
        some = going[k : k + 1_000_000]
        own, other = at[some], at[least[group[some]]]
        for step in steps:
            equal[k : k + len(some)] &= words[own + step] == words[other + step]
    for g in set(group[going[~equal]].tolist()):
        members = np.flatnonzero(group == g)
        smallest: dict[bytes, int] = {}
        for i in members:
            own = data[at[i] : at[i] + length]
            smallest[own] = min(int(owner[i]), smallest.get(own, int(owner[i])))
        for i in members:
            later[order[i]] = smallest[data[at[i] : at[i] + length]] < owner[i]


class SuffixIndex:
    """A family of levels; add() takes a batch's arrays (slot, part, keys, shared) and returns the beginnings that hit."""

    def __init__(self, ws: Workspace):
        self.ws, self.levels, self.names, self.batches = ws, {}, {}, 0

    def add(self, arrays: DataFrame, more: bool = True) -> DataFrame:
        """part, keys: beginnings in this batch that two of its documents or an earlier document have. more: the batch joins the index."""
        absorbed = []
        while len(absorbed) in self.levels:
            absorbed.append(len(absorbed))
        rows = arrays.select(F.lit(0).alias("level"), "part", "keys", "shared")
        for size, level in self.levels.items():
            # 1: merges with the batch; 2: is scanned only
            rows = rows.unionByName(level.select(F.lit(1 if size in absorbed else 2).alias("level"), "part", "keys", F.lit(None).cast("binary").alias("shared")))

        def scan(group: pa.Table) -> pa.Table:
            level, keys, shared = (group.column(c).to_pylist() for c in ("level", "keys", "shared"))
            arrays = [unpacked_keys(k) for k in keys]
            batch = np.concatenate([NONE, *(a for n, a in zip(level, arrays, strict=True) if n == 0)])
            inside = np.concatenate([np.zeros(0, bool), *(_bits(s, len(a)) for n, a, s in zip(level, arrays, shared, strict=True) if n == 0)])
            order = in_order(batch)
            batch, inside = batch[order], inside[order]
            again = shares_prefix(batch)
            new, hits = batch[~again], [batch[again], batch[inside]]
            merged = [new]
            for n, old in zip(level, arrays, strict=True):
                if n and len(old):
                    hits.append(new[found_in(new, old)])
                    if n == 1:
                        merged.append(old)
            part = group.column("part")[0].as_py()
            out = [("hits", distinct_keys(np.concatenate(hits)))] + ([("level", distinct_keys(np.concatenate(merged)))] if more else [])
            return _message(kind=[k for k, _ in out], part=[part] * len(out), keys=[packed_keys(x) for _, x in out])

        name = f"step{self.batches}"
        step = self.ws.save(rows.groupBy("part").applyInArrow(scan, "kind string, part long, keys binary"), name, by="kind")
        if more:
            for size in absorbed:
                del self.levels[size]
                self.ws.drop(f"{self.names.pop(size)}/kind=level")
            self.levels[len(absorbed)] = step.filter("kind = 'level'").select("part", "keys")
            self.names[len(absorbed)] = name
        self.batches += 1
        return step.filter("kind = 'hits'").select("part", "keys")


def suffix_dedup(docs: DataFrame, length: int = 50, batches: int = 8, slot_bytes: int = SLOT_BYTES, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """k, n_bytes, n_removed, n_spans and kept (the remaining bytes) for each row of docs; length is PREFIX + 8 at least."""
    if length < PREFIX + 8:
        raise ValueError(f"length is {PREFIX + 8} at least")
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix-dedup")
    size = docs.agg(F.sum(F.octet_length(docs[text]).cast("long"))).first()[0] or 0
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = math.ceil(max(at_least, size / slot_bytes) / batches)
    parts = max(at_least, math.ceil(size / PART_BYTES))
    k = docs[key].cast("long")
    bounds = docs.select(k.alias("k")).approxQuantile("k", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = reduce(lambda a, b: a + b, [F.when(k <= int(x), 0).otherwise(1) for x in bounds], F.lit(0))
    slot = batch * each + F.pmod(F.xxhash64(docs[key], docs[text]), F.lit(each))
    rows = docs.select(slot.cast("long").alias("slot"), k.alias("k"), docs[text].cast("binary").alias("data"))

    def arrays(slot: pa.Table) -> pa.Table:
        runs = Runs(_sorted_texts(slot)[1], length, parts, counted=True)
        own = list(runs.by_part())
        return _message(
            slot=[slot.column("slot")[0].as_py()] * len(own), part=[p for p, _ in own], keys=[packed_keys(runs.keys[s]) for _, s in own], shared=[_packed(runs.shared[s]) for _, s in own],
            kinds=[zlib.compress(runs.kinds[s].astype("<u2").tobytes(), 1) for _, s in own],
        )

    sampled = ws.save(rows.groupBy("slot").applyInArrow(arrays, "slot long, part long, keys binary, shared binary, kinds binary"), "arrays")
    def mark(asked: pa.Table, found: pa.Table) -> pa.Table:
        known = distinct_keys(np.concatenate([NONE, *(unpacked_keys(x) for x in found.column("keys").to_pylist())]))
        arrays = [unpacked_keys(x) for x in asked.column("keys").to_pylist()]
        kinds = [np.frombuffer(zlib.decompress(x), "<u2").astype(np.int64) for x in asked.column("kinds").to_pylist()]
        every = np.concatenate([NONE, *arrays])
        order = in_order(every)
        start = np.flatnonzero(~shares_prefix(every[order]))
        many = np.zeros(len(every), bool)
        if len(every):
            surroundings = np.add.reduceat(np.concatenate(kinds)[order], start)
            many[order] = np.repeat(surroundings >= hot, np.diff(np.append(start, len(order))))
        hits, cuts = found_in(every, known), np.cumsum([0, *(len(a) for a in arrays)])
        bits = [_packed(np.concatenate([hits[a:b], many[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return _message(slot=asked.column("slot").to_pylist(), part=asked.column("part").to_pylist(), bits=bits)

    def marked(i: int) -> DataFrame:
        """The marks of one range of parts, from an index of its own, whose tables then go."""
        own = Workspace(spark, f"suffix-index{i}")
        some = sampled.filter((F.col("part") >= (i * parts) // RANGES) & (F.col("part") < ((i + 1) * parts) // RANGES))
        index, hits = SuffixIndex(own), []
        for k in range(batches):
            hits.append(index.add(some.filter((F.col("slot") >= k * each) & (F.col("slot") < (k + 1) * each)), more=k + 1 < batches))
        found = reduce(DataFrame.unionAll, hits)
        marks = ws.save(some.select("slot", "part", "keys", "kinds").groupBy("part").cogroup(found.groupBy("part")).applyInArrow(mark, "slot long, part long, bits binary"), f"marks{i}")
        own.drop()
        return marks

    marks = reduce(DataFrame.unionAll, [marked(i) for i in range(RANGES)])
    ws.drop("arrays")

    def send(slot: pa.Table, marked: pa.Table) -> pa.Table:
        keys, texts, _ = _sorted_texts(slot)
        found = Candidates(keys, texts, Runs(texts, length, parts), dict(zip(marked.column("part").to_pylist(), marked.column("bits").to_pylist(), strict=True)), length, parts)
        own = slot.column("slot")[0].as_py() if slot.num_rows else None
        rows = [(p, _shrunk(np.array([keys[i] for i, *_ in x], np.int64).tobytes()), _spans(x), _shrunk(b"".join(s for *_, s in x))) for p, x in found.sent.items()]
        if found.settled:
            rows.append((-1 - own, b"", _spans(found.settled), b""))  # a group of its own, which is passed on
        part, owner, spans, strings = zip(*rows, strict=True) if rows else ((), (), (), ())
        return _message(slot=[own] * len(rows), part=part, owner=owner, spans=spans, strings=strings)

    def settle(part: pa.Table) -> pa.Table:
        part = part.sort_by("slot")
        if part.column("part")[0].as_py() < 0:
            return _message(slot=part.column("slot").to_pylist(), part=part.column("part").to_pylist(), spans=part.column("spans").to_pylist(), bits=[b""] * part.num_rows)
        hashes, owner, counts, at, texts, size_before = [], [], [], [], [], 0
        for own, spans, strings in zip(*(part.column(c).to_pylist() for c in ("owner", "spans", "strings")), strict=True):
            _, first, last = _read_spans(spans)
            size, own, strings = last - first + length, _grown(own), _grown(strings)
            texts.append(strings)
            place, mixed = _places(size, length), _mixed(strings + bytes(8))
            hashes.append(_hashed(mixed, place, length, 1))
            owner.append(np.repeat(np.frombuffer(own, np.int64), size - length + 1))
            counts.append(len(place))
            at.append(place + size_before)
            size_before += len(strings)
        hashes, owner = np.concatenate(hashes), np.concatenate(owner)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(owner[order], starts)
        later = np.empty(len(order), bool)
        later[order] = least[group] < owner[order]
        confirm(b"".join(texts), np.concatenate(at)[order], starts, group, owner[order], later, order, length)
        cuts = np.cumsum([0, *counts])
        return _message(slot=part.column("slot").to_pylist(), part=part.column("part").to_pylist(), spans=part.column("spans").to_pylist(), bits=[_packed(later[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    asked = rows.groupBy("slot").cogroup(marks.groupBy("slot")).applyInArrow(send, "slot long, part long, owner binary, spans binary, strings binary")
    answers = ws.save(asked.groupBy("part").applyInArrow(settle, "slot long, part long, spans binary, bits binary"), "answers")

    def finish(slot: pa.Table, said: pa.Table) -> pa.Table:
        _, texts, own = _sorted_texts(slot)
        size = np.array([len(t) for t in texts], np.int64)
        offset = np.cumsum(size) - size
        gone = np.zeros(int(size.sum()) + 1, bool)  # of string starts
        for part, spans, answered in zip(*(said.column(c).to_pylist() for c in ("part", "spans", "bits")), strict=True):
            text, first, last = _read_spans(spans)
            first, last = (offset[text] + first).tolist(), (offset[text] + last).tolist()
            if part < 0:  # other strings of the slot have settled them
                for a, b in zip(first, last, strict=True):
                    gone[a : b + 1] = True
                continue
            bits, at = _bits(answered, sum(last) - sum(first) + len(first)), 0
            for a, b in zip(first, last, strict=True):
                gone[a : b + 1] |= bits[at : at + b - a + 1]
                at += b - a + 1
        count = np.cumsum(gone, dtype=np.int32)
        covered = count > 0
        covered[length:] = count[length:] > count[:-length]
        out = []
        for k, text, at in zip(own, texts, offset.tolist(), strict=True):
            mask = covered[at : at + len(text)]
            removed = int(mask.sum())
            spans = int((mask[1:] & ~mask[:-1]).sum()) + int(mask[0]) if removed else 0
            out.append((k, len(text), removed, spans, np.frombuffer(text, np.uint8)[~mask].tobytes() if removed else text))
        k, n, r, s, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pa.table({"k": pa.array(k, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "n_spans": pa.array(s, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return rows.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(finish, "k long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
