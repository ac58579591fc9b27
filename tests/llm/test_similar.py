"""Near copies by Jaccard similarity against brute force."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from watchshelf.llm import similar, simhash
from watchshelf.llm.common import table

from conftest import DATA


def brute_groups(docs, similarity=0.8, size=5):
    sets = {}
    for k, x in docs.items():
        words = (x or "").encode().lower().split()
        sets[k] = frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) >= similarity * union - 1e-9:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {k: find(k) for k in docs}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("common", [True, False])
def test_all_similar_pairs_by_brute_force(spark, monkeypatch, common):
    if not common:
        monkeypatch.setattr(similar, "COMMON", 1)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \n", "one", "One", "two words", "two  WORDS", "a b c d e", "a b c d e f"]
    for base in range(12):
        words = [f"w{base}x{i}" for i in range(120)]
        texts += [" ".join(edited(rng, words, n)) for n in (0, 1, 2, 2, 3, 3, 4, 5, 8)]
    texts += [" ".join([*passage, *(f"own{j}x{i}" for i in range(n))]) for j, n in enumerate((0, 5, 10, 14, 15, 16, 20, 40, 60))]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    expected = brute_groups(docs)
    found = {r.k: r.root for r in similar.groups(df).collect()}
    least = {}
    for k in sorted(found):
        least.setdefault(found[k], k)
    assert {k: least[g] for k, g in found.items()} == expected
    assert sorted(r.doc_id for r in similar.one_of_each(df).collect()) == sorted(set(expected.values()))


def test_the_stage_keeps_one_of_similar_documents(spark):
    docs = table(spark, str(DATA), "documents")
    expected = brute_groups({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(DATA)).collect()) == sorted(set(expected.values()))


def test_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone with no key at all"), (1, "another text of the same key")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, similar.one_of_each(df).collect())) == sorted(map(str, df.filter(F.col("doc_id").isNotNull() | (F.col("text") == rows[3][1])).collect()))
    assert similar.one_of_each(df.limit(0)).count() == 0


def test_near_copies_of_one_text_that_are_unlike_each_other(spark, monkeypatch):
    """Copies with three edits are like those with one, but not like each other; further passes join most of them before pairs are compared."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    docs = dict(enumerate(" ".join(edited(rng, words, rng.choice((1, 3, 3, 3)))) for _ in range(120)))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    left = []
    crossing = similar._crossing
    monkeypatch.setattr(similar, "_crossing", lambda entry, similarity: left.append(crossing(entry, similarity)) or left[-1])
    found = {r.k: r.root for r in similar.groups(df).collect()}
    least = {}
    for k in sorted(found):
        least.setdefault(found[k], k)
    assert {k: least[g] for k, g in found.items()} == brute_groups(docs)
    assert left and left[-1] <= 2 * 120 * 50  # what is left is in proportion to the entries


def families(rng):
    texts = []
    for base in range(10):
        words = [f"w{base}x{i}" for i in range(rng.choice((12, 40, 150)))]
        texts += [" ".join(edited(rng, words, n)) for n in (0, 1, 1, 2, 3, 4)]
    return dict(enumerate(texts))


def least_of(found):
    least = {}
    for k in sorted(found):
        least.setdefault(found[k], k)
    return {k: least[g] for k, g in found.items()}


def test_shuffles_go_in_slices(spark, monkeypatch):
    docs, saved, save = families(random.Random(13)), [], similar.Workspace.save
    monkeypatch.setattr(similar.Workspace, "save", lambda self, df, name, by=None: saved.append(name) or save(self, df, name, by))
    monkeypatch.setattr(similar, "ROOM_BYTES", 12_000)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert least_of({r.k: r.root for r in similar.groups(df).collect()}) == brute_groups(docs)
    assert {"met/slice1", "first-sets/slice1", "first-pairs/slice1", "first-links/slice1"} <= set(saved)


def test_fingerprints_of_the_numbered_operator_link_first(spark, monkeypatch):
    docs, seen, links = families(random.Random(14)) | {900: "", 901: None, 902: "a b", 903: "A  b"}, {}, similar.near_links

    def watched(prints, ws, *more):
        seen.update((r.fp & (1 << 64) - 1, r.node) for r in prints.collect())
        return links(prints, ws, *more)

    monkeypatch.setattr(similar, "near_links", watched)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert least_of({r.k: r.root for r in similar.groups(df).collect()}) == brute_groups(docs)
    assert set(seen) == {simhash.fingerprint((x or "").encode(), 5) for x in docs.values()}


def test_sketches_differ_in_at_most_the_members_that_two_sets_do_not_share():
    rng = np.random.default_rng(15)
    for n, m in ((0, 0), (0, 3), (1, 1), (40, 33), (500, 450), (500, 90), (3000, 3000)):
        for shared in {0, min(n, m) // 2, min(n, m)}:
            members = np.unique(rng.integers(0, 1 << 64, n + m - shared, np.uint64))
            rng.shuffle(members)
            a, b = np.sort(members[:n]), np.sort(members[n - shared :])
            assert similar.apart(similar.sketch(a), similar.sketch(b)) <= n + m - 2 * shared
            assert similar.apart(similar.sketch(a), similar.sketch(a)) == 0


def test_texts_whose_sketches_are_too_far_apart_are_not_read_again(spark, monkeypatch):
    """Pairs of similarity 0.6 to 0.7 share enough of their prefixes, but none of them needs its whole sets."""
    rng, asked, save = random.Random(16), [], similar.Workspace.save

    def watched(self, df, name, by=None):
        saved = save(self, df, name, by)
        asked.extend(r.node for r in (saved.collect() if name.endswith("-asked") else []))
        return saved

    monkeypatch.setattr(similar.Workspace, "save", watched)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(edited(rng, words, 8)) for _ in range(12)]
    docs = dict(enumerate([*texts, f"{texts[0]} and one more"]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert least_of({r.k: r.root for r in similar.groups(df).collect()}) == brute_groups(docs)
    assert len(set(asked)) == 2
