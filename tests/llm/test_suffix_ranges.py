"""Suffix-array dedup with its parts indexed range by range."""

from __future__ import annotations

import random

from watchshelf.llm import suffix_dedup as module


def test_ranges_of_parts_by_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    passages = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice((49, 50, 51, 90)))) for _ in range(8)]
    docs = {k: b"".join(rng.choice(passages) if rng.random() < 0.4 else bytes(rng.choice(b"wxyz ") for _ in range(30)) for _ in range(6)) for k in range(40)}
    seen, expected = {}, {}
    for k, x in sorted(docs.items()):
        for i in range(len(x) - 49):
            seen.setdefault(x[i : i + 50], k)
    for k, x in docs.items():
        gone = {j for i in range(len(x) - 49) if seen[x[i : i + 50]] < k for j in range(i, i + 50)}
        expected[k] = bytes(c for j, c in enumerate(x) if j not in gone)
    indexes, drop, saved, save = [], module.Workspace.drop, [], module.Workspace.save
    monkeypatch.setattr(module.Workspace, "save", lambda self, df, name, by=None: saved.append((self.root, name)) or save(self, df, name, by))
    monkeypatch.setattr(module.Workspace, "drop", lambda self, *names: (indexes.append(self.root) if not names else None, drop(self, *names))[1])
    df = spark.createDataFrame([(k, x.decode()) for k, x in docs.items()], "doc_id long, text string")
    assert {r.k: bytes(r.kept) for r in module.suffix_dedup(df, batches=3).collect()} == expected
    steps = {root for root, name in saved if name.startswith("step")}
    assert len(steps) > 1 and steps <= set(indexes)  # an index for each range, and none of them stays
