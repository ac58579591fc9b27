"""Filters in all orders against a replay in plain Python; edge cases."""

from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from watchshelf.llm import filter_audit
from watchshelf.llm.common import table

from conftest import DATA

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """docs: (doc_id, text, source). The contract, document by document."""
    rows = []
    for k, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        copy = k is not None and any(j is not None and j < k and (t or "") == text for j, t, _ in docs)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": copy,
        }
        rows.append((source or "", fails, any(j == k and q == 1 for j, q, _ in labels if k is not None), any(j == k and t == 1 for j, _, t in labels if k is not None)))
    found = {}
    for order in map("".join, permutations("ABCDE")):
        for part, fails, good, toxic in rows:
            first = next((i for i, f in enumerate(order, 1) if fails[f]), 6)
            for i, f in enumerate(order, 1):
                x = found.setdefault((part, order, i), [0] * 6)
                for j, yes in enumerate((first > i, first == i, fails[f] and first < i, fails[f] and sum(fails.values()) == 1, first == i and good, first == i and toxic)):
                    x[j] += yes
    shapley = {}
    for (part, order, i), x in found.items():
        shapley[part, order[i - 1]] = shapley.get((part, order[i - 1]), 0) + x[1]
    return {(p, o, i): (*x, shapley[p, o[i - 1]]) for (p, o, i), x in found.items()}


def replayed(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_all_orders_by_brute_force(spark):
    docs, labels = table(spark, str(DATA), "documents"), table(spark, str(DATA), "labels")
    expected = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert replayed(filter_audit.op13_filter_audit(spark, str(DATA))) == expected


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, None, None), (2, "", "s"), (3, long, "s"), (3, long, "s"), (4, long, "t"), (None, long, "s"), (5, long + " #", ""), (6, "A" * 10, "s"), (7, " ".join(["same"] * 200_000), "t"), (8, f"\n\t{long}\x0b", "s"),
        (9, "\xa0".join(["w"] * 60), "t"), (10, " ".join(f"w{i % 39}" for i in range(60)), "t"), (11, " ".join(f"w{i % 38}" for i in range(60)), "t"), (-1, "x" * 19 + "A", "t"), (-2, "x" * 18 + "A", "t"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, None), (3, 1, 1), (None, 1, 1), (99, 1, 1), (7, None, None), (6, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("id", "part", "fails", "sha", "first", "good", "toxic", "steps", "step", "bit", "kept", "filter_order", "quality")})
    marks = spark.createDataFrame(labels, LABELS).withColumns({c: F.lit("clash") for c in ("id", "part", "fails")})
    assert replayed(filter_audit.filter_audit(df, marks)) == brute(docs, labels)
    assert len(replayed(filter_audit.filter_audit(df, marks.limit(0)))) == 600 * 3
    assert filter_audit.filter_audit(df.limit(0), marks).count() == 0


@pytest.mark.parametrize("copies", [3000])
def test_a_hot_text_and_source(spark, copies):
    """Most rows share one text and one source: all but the first are copies, whatever the order."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.range(copies).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("hot").alias("source"))
    found = replayed(filter_audit.filter_audit(df, spark.createDataFrame([], LABELS)))
    assert len(found) == 600
    assert all(x[1] == (copies - 1 if o[i - 1] == "E" else 0) for (_, o, i), x in found.items())
    assert {x[6] for (_, o, i), x in found.items() if o[i - 1] == "E"} == {120 * (copies - 1)}
