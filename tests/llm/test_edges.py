"""Very long texts, hostile trees and shared benchmark windows."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from watchshelf.llm import chat, decontaminate, line_dedup

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def one(spark, text):
    return spark.createDataFrame([(1, "a\nb\nc"), (2, text)], "doc_id long, text string")


def test_a_hundred_thousand_lines(spark):
    lines = [f"line {i}" for i in range(100_000)]
    began = time.monotonic()
    found = {r.doc_id: r for r in line_dedup.line_dedup(one(spark, "\n".join([*lines, "a", "b", "c", "end"]))).collect()}
    assert found[2].text == "\n".join([*lines, "end"]) and found[2].n_removed == 3
    assert time.monotonic() - began < 30


def test_a_hundred_thousand_words(spark):
    item = "one two three four five six seven eight nine ten"
    words = " ".join(f"w{i}" for i in range(100_000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    began = time.monotonic()
    found = {r.doc_id: r.text for r in decontaminate.decontaminate(one(spark, f"{words} {item} end"), bench, mode="spans").collect()}
    assert found[2] == f"{words} end"
    assert time.monotonic() - began < 30


def test_items_of_all_sizes_and_shared_windows(spark):
    words = [f"w{i}" for i in range(30)]
    bench = [(n, " ".join(words[:n])) for n in range(1, 13)] + [(100 + i, " ".join(words[2:14])) for i in range(5)] + [(None, "w20 w21"), (None, "w20 w21 w22"), (50, None), (51, "...")]
    docs = [(1, " ".join(words)), (2, "x " + " ".join(words[2:12])), (3, "w20 W21!"), (4, None), (5, ""), (6, "nothing"), (None, "w0 w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")

    def brute(text):
        own, items, hit = (text or "").lower().replace("!", "").split(), set(), set()
        for item, x in bench:
            wanted = (x or "").replace(".", "").split()
            size = min(10, len(wanted))
            for a in range(len(wanted) - size + 1) if wanted else ():
                for i in range(len(own) - size + 1):
                    if own[i : i + size] == wanted[a : a + size]:
                        items.add(item)
                        hit |= set(range(i, i + size))
        return sorted(hit), sorted(items, key=str)

    for most in (10**9, 0):
        found = decontaminate.contamination(frame, spark.createDataFrame(bench, "item_id long, text string"), max_broadcast=most).collect()
        assert {r.k: (sorted(r.hit or ()), sorted(r["items"] or (), key=str)) for r in found} == {k: brute(x) for k, x in docs}


def test_an_empty_benchmark(spark):
    docs, none = one(spark, "text"), spark.createDataFrame([], "item_id string, text string")
    assert [r.hit for r in decontaminate.contamination(docs, none).collect()] == [None, None]
    assert decontaminate.decontaminate(docs, none).count() == 2


def test_repeated_messages_and_cycles_with_tails(spark):
    chain = [(1, i, i - 1 if i else None, "user", f"t{i}", 0.0) for i in range(5)]
    cycle = [(2, 1, 2, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0), (2, 3, 1, "user", "tail", 0.0), (2, 4, 3, "user", "end", 0.0)]
    other = [(None, 1, None, "user", "no tree", None), (3, None, None, "user", "no node", 0.0), (4, 1, 1, "user", "its own parent", 0.0)]
    rows = chain * 2 + [(1, 2, 3, "zz", "another row of the same message", 9.0)] + cycle + other
    found = {r.tree: r for r in chat.conversations_of(spark.createDataFrame(rows, MESSAGES), top=5).collect()}
    assert set(found) == {1, None}
    assert found[1].n_turns == 5 and found[1].formatted == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(5))


def test_a_deep_tree_with_a_leaf_at_each_message(spark):
    """A caterpillar: a spine of 400 messages, each with an answer of its own; the best branch is one in the middle."""
    spine = [(1, i, i - 1 if i else None, "user", f"s{i}", 1.0 if i <= 200 else 0.0) for i in range(400)]
    leaves = [(1, 1000 + i, i, "assistant", f"l{i}", 1.0) for i in range(400)]
    found = chat.conversations_of(spark.createDataFrame(spine + leaves, MESSAGES), top=2).orderBy("rank").collect()
    assert [(r.leaf, r.n_turns, r.score) for r in found] == [(1200, 202, 1.0), (1199, 201, 1.0)]
    assert found[0].formatted.count("<|im_start|>") == 202 and found[0].segments[-2].loss


def test_scores_without_a_tree(spark):
    assert chat.conversations_of(spark.createDataFrame([], MESSAGES)).count() == 0
    assert chat.from_turns(spark.createDataFrame([(None, 0, "user", "a")], "conv_id long, turn long, role string, text string")).filter(F.col("tree").isNull()).count() == 1
