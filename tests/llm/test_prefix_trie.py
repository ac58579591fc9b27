"""Prefix tries against nodes counted one by one; large first turns that are dealt anew; edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from watchshelf.llm import prefix_trie
from watchshelf.llm.common import table

from conftest import DATA

CONVS = "conv_id long, turn long, role string, text string"


def paths_of(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return {c: tuple(v) for c, v in own.items()}
    found = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - c % 5, []) if c >= 0 else own.get(c + (-c) % 5, [])
        found[c] = tuple(base[:h] + v[h:])
    return found


def brute(paths):
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    saving = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    found = {}
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        found[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), sum(saving[q] for q in under), hashlib.sha256(ends.encode()).hexdigest())
    return found


def nodes_of(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def tries_of(df, rebuild=True, **options):
    return nodes_of(prefix_trie.prefix_trie(prefix_trie.rebuilt(df) if rebuild else prefix_trie.turn_paths(df), **options))


def test_the_given_conversations_by_brute_force(spark):
    rows = [tuple(r) for r in table(spark, str(DATA), "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(prefix_trie.op12_prefix_trie(spark, str(DATA))) == brute(paths_of(rows))


@pytest.mark.parametrize("max_turns", [1, 4, 30, 10_000])
def test_shared_beginnings_and_copies_split_at_any_size(spark, max_turns):
    """A hot first turn with branches at all depths, whole conversations that many share, and lone long ones."""
    rng = random.Random(5)
    rows = []
    for c in range(120):
        if c % 3 == 0:
            turns = ["hot", "a", "b"]
        elif c % 3 == 1:
            turns = ["hot", *(rng.choice("abc") for _ in range(rng.randrange(6)))]
        else:
            turns = [rng.choice("xyz") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))]
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(turns)]
    rows += [(500, i, "user", f"t{i}") for i in range(40)] + [(501, i, "user", f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, CONVS)
    assert tries_of(df, rebuild=False, max_turns=max_turns) == brute(paths_of(rows, rebuild=False))
    assert tries_of(df, max_turns=max_turns) == brute(paths_of(rows))


def test_edges(spark):
    rows = [
        (0, 0, "user", None), (0, 1, None, ""), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (2, 5, "a", "x"), (2, 5, "b", "x"), (2, 5, "b", "x"), (None, 0, "user", "no id"),
        (7, 0, "user", "é漢" * 30_000), (8, 0, "user", "é漢" * 30_000), (-3, 0, "user", "negative"), (-5, 0, "user", "negative"), (12, 0, "user", "base is absent"), (13, 0, "user:", "x"), (14, 0, "user", ":x"),
    ]
    df = spark.createDataFrame(rows, CONVS).withColumns({c: F.lit("clash") for c in ("path", "group", "key", "n", "low", "level", "up", "head", "h")})
    assert tries_of(df) == brute(paths_of(rows))
    assert tries_of(df, rebuild=False) == brute(paths_of(rows, rebuild=False))
    assert tries_of(df.limit(0)) == {}
    assert tries_of(df.filter("conv_id = 12")) == brute(paths_of(rows[13:14]))  # without turns: the root alone


def test_ends_of_many_copies_over_ranges_of_ids(spark):
    """Thousands of ids that share a path, in several ranges and out of order."""
    ids = [*range(0, 20_000, 7), 10**12, -(10**9)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(c, 0, "user", "copy") for c in ids], CONVS)
    found = tries_of(df, rebuild=False)
    assert found == {(min(ids), 0): (None, len(ids), 1, 1, 4 * (len(ids) - 1), prefix_trie.NO_ENDS), (min(ids), 1): (min(ids), len(ids), 0, 1, 4 * (len(ids) - 1), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())}
