"""Pieces and ids by the tokenizers library, packings by exact search, bounds and edge cases."""

from __future__ import annotations

import random
import struct
import zlib
from functools import cache

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from watchshelf.llm import packing
from watchshelf.llm.common import table

from conftest import DATA

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def least_bins(lengths, size):
    """The least number of bins by exhaustive search, for a dozen items."""
    lengths = tuple(sorted(lengths, reverse=True))

    @cache
    def fits(left, rooms):
        if not left:
            return True
        return any(rooms[j] >= left[0] and fits(left[1:], tuple(sorted(rooms[:j] + (rooms[j] - left[0],) + rooms[j + 1 :]))) for j in range(len(rooms)) if j == 0 or rooms[j] != rooms[j - 1])

    return next(n for n in range(-(-sum(lengths) // size), len(lengths) + 1) if fits(lengths, (size,) * n))


def valid(lengths, bins, size):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(b and sum(lengths[i] for i in b) <= size for b in bins)


def test_small_packings_by_exhaustive_search():
    rng = random.Random(2)
    extra = 0
    for _ in range(60):
        lengths = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 12))]
        bins = packing.packed(lengths, size=20)
        valid(lengths, bins, 20)
        extra += len(bins) - least_bins(lengths, 20)
    assert extra == 0


def test_the_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(3)
    lengths = [rng.randrange(200, 500) for _ in range(1500)]
    own = packing.Bins(lengths, 1024)
    own.best_fit(list(range(len(lengths))))
    before, squares = len(own.held), sum((1024 - r) ** 2 for r in own.room)
    own.search()
    bins = [x for x in own.held if x]
    valid(lengths, bins, 1024)
    assert sum(sum(lengths[i] for i in b) ** 2 for b in bins) > squares
    assert len(bins) < 0.98 * before


@pytest.mark.parametrize(("given", "lengths"), [([[6, 3], [5, 3], [2]], None), ([[7], [4, 2], [3, 1]], None), ([[9], [6, 3], [2, 1, 1]], None)])
def test_each_action_by_hand(given, lengths):
    """A move, an exchange of one for one and of two for one: three bins of 10 that can become two, or as many as there must be."""
    flat = [x for b in given for x in b]
    bins = packing.packed(flat, [k for k, b in enumerate(given) for _ in b], size=10)
    valid(flat, bins, 10)
    assert len(bins) == least_bins(flat, 10)


def test_cutting():
    assert [packing.pieces_of(n, 4) for n in (1, 4, 5, 8, 9)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 4)], [(0, 4), (4, 4)], [(0, 1), (1, 4), (5, 4)]]


def checked(rows, texts, size=1024):
    """Pieces of all texts with right ids; sequences without gaps. Returns the number of sequences."""
    whole, by, seqs = Tokenizer.from_file(VOCABULARY), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for k, own in by.items():
        ids = [*whole.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(i, *x) for i, x in enumerate(packing.pieces_of(len(ids), size))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs)


def test_the_given_documents(spark):
    rows = packing.op11_packing(spark, str(DATA)).collect()
    n = checked(rows, {r.doc_id: r.text for r in table(spark, str(DATA), "documents").collect()})
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1


TEXTS = [None, "", " ", "a", "<|endoftext|> twice <|endoftext|>", " " * 300_000, "x" * 300_000, "\n\t " * 20_000 + "end", "é漢😀\x00" * 500, "don't 1234 #$%", "word " * 20_000]


def test_edges(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("k", "piece", "item", "bin", "fill", "shard", "offset", "length", "ids")})
    pieces = packing.tokenized(docs, VOCABULARY, RANKS)
    checked(packing.pack(pieces).withColumnRenamed("k", "doc_id").collect(), dict(enumerate(TEXTS)))
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id") % 4))
    found = packing.pack(packing.tokenized(odd, VOCABULARY, RANKS)).collect()
    assert sum(r.length for r in found) == pieces.agg(F.sum("length")).first()[0] and sum(r.k is None for r in found) == 3
    assert packing.pack(packing.tokenized(docs.limit(0), VOCABULARY, RANKS)).count() == 0


def test_many_shards_meet_in_fewer(spark):
    """Hundreds of pieces in shards of twenty: later rounds empty bins that no shard could, and no piece is lost."""
    rng = random.Random(4)
    lengths = [rng.randrange(1, 1025) for _ in range(600)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long")
    counts = {}
    for shard in (20, 600):
        rows = packing.pack(pieces, shard=shard).collect()
        assert sorted((r.k, r.length) for r in rows) == list(enumerate(lengths))
        fills = {}
        for r in rows:
            fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
        assert max(fills.values()) <= 1024
        counts[shard] = len(fills)
    alone = sum(len(packing.packed(lengths[i : i + 20])) for i in range(0, 600, 20))
    assert counts[600] <= counts[20] < alone


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"some words of {i} " * (40 * i)) for i in range(12)], "doc_id long, text string")
    packs = packing.pack(packing.tokenized(docs, VOCABULARY, keep_ids=True))
    whole = Tokenizer.from_file(VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = {}
    for r in packs.collect():
        ids = [*whole.encode(texts[r.k], add_special_tokens=False).ids, 2][r.start : r.start + r.length]
        expected.setdefault(r.sequence_id, []).append((r.offset, ids))
    found = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(packs).collect()}
    assert found == {s: (sum(len(i) for _, i in x), b"".join(struct.pack(f"<{len(i)}I", *i) for _, i in sorted(x))) for s, x in expected.items()}
