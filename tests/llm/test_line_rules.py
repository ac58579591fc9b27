"""Texts without their frequent lines, by brute force and by SQL on a host large enough to lose lines."""

from __future__ import annotations

import random

from watchshelf.llm import line_rules
from watchshelf.llm.queries import ORACLES, QUERIES

from conftest import rows_of, rows_of_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def norm(line):
    return b" ".join(line.encode().split()).lower()


def brute_cleaned(docs, min_docs, max_share):
    """docs: (key, host, text); per host the lines of more than the limits of distinct texts go."""
    hosts = {}
    for _, host, text in docs:
        hosts.setdefault(host, set()).add(text or "")
    gone = {}
    for host, texts in hosts.items():
        count = {}
        for text in texts:
            for h in {norm(x) for x in text.split("\n") if norm(x)}:
                count[h] = count.get(h, 0) + 1
        gone[host] = {h for h, n in count.items() if n > min_docs and n > max_share * len(texts)}
    return {k: text and "\n".join(x for x in text.split("\n") if not norm(x) or norm(x) not in gone[host]) for k, host, text in docs}


def test_cleaned_texts_by_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(4)
    foot = ["Terms and conditions apply to every reader", "  terms AND conditions\tapply to every reader ", "All rights reserved é 漢"]
    rows = [(0, None, "en", "big", None), (1, "", "en", None, None), (2, "\n \n", "en", "big", None)]
    for i in range(3, 330):
        own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 6, 12, 30]))) for _ in range(rng.randrange(1, 3))]
        host = "big" if i % 3 else None if i % 2 else "small"
        rows.append((i, "\n".join([*own, "", rng.choice(foot), foot[2]]), "en", host, None))
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    assert {r.doc_id: r for r in line_rules.line_rules(docs, max_broadcast=0).collect()} == found
    expected = brute_cleaned([(r[0], r[3], r[1]) for r in rows], 5, 0.02)
    assert {k: r.cleaned for k, r in found.items()} == expected
    assert any(r.n_line_words for r in found.values()) and any(not r.kept and not r.base_failed for r in found.values())
    # SQL joins hosts by equality, so its fixture has none that is null
    docs.fillna("none", ["source"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(QUERIES["op9_line_rules"](spark, str(tmp_path))) == rows_of_sql(ORACLES["op9_line_rules"], tmp_path)


def test_lines_at_the_limits_stay(spark):
    line = "exactly as often as the limit says"
    for n, total, gone in ((5, 20, False), (6, 20, True), (8, 400, False), (9, 400, True)):
        rows = [(i, (line + "\n" if i < n else "") + f"own words number {i}", "en", "s", None) for i in range(total)]
        found = line_rules.line_rules(spark.createDataFrame(rows, DOCS)).filter("doc_id = 0").collect()
        assert (line not in found[0].cleaned) == gone, (n, total)


def test_copies_count_once_and_long_texts_work(spark):
    line = "a line that copies share"
    rows = [(i, f"{line}\nthe same text in all copies", "en", "s", None) for i in range(30)] + [(99, "\n".join(f"line {i} of many" for i in range(100_000)), "en", "s", None)]
    found = {r.doc_id: r for r in line_rules.line_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(r.n_line_words == 0 for r in found.values()) and found[99].n_words == 400_000
