"""Rates against a brute-force fit, bounds that bind, and tables without rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from watchshelf.llm import mixing
from watchshelf.llm.common import table

SOFT = "k long, n_tokens long, p array<double>"


def brute_rates(tokens, p, targets, least, steps=30_000):
    """Accelerated projected gradient on all rows' rates at once in NumPy: another way to the same least squares."""
    a = (tokens[:, None] * p).T / (tokens @ p)[:, None]
    goal, size = np.array(targets) / (tokens @ p), np.linalg.norm(a, 2) ** 2
    rate = ahead = np.ones(len(tokens))
    for k in range(steps):
        new = np.maximum(least, ahead - a.T @ (a @ ahead - goal) / size)
        rate, ahead = new, new + k / (k + 3) * (new - rate)
    return a @ rate - goal


@pytest.mark.parametrize(("least", "total"), [(0.0, None), (0.0, 900.0), (1.0, None), (0.5, 3000.0)])
def test_misses_by_brute_force(spark, least, total):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(5, 60, 40), rng.dirichlet([0.3, 0.2, 0.4], 40)
    soft = spark.createDataFrame([(i, int(n), list(map(float, x))) for i, (n, x) in enumerate(zip(tokens, p, strict=True))], SOFT)
    weights = [0.85, 0.1, 0.05]
    rate, history = mixing.fit_rates(soft, weights, total_tokens=total, least=least)
    rows = sorted(soft.withColumn("rate", rate).collect())
    rate = np.array([r.rate for r in rows])
    natural = tokens @ p
    size = total or 1.02 * max(natural / weights)
    miss = ((tokens * rate) @ p - np.array(weights) * size) / natural
    assert np.allclose(miss, history[-1], atol=1e-9) and rate.min() >= least
    expected = brute_rates(tokens, p, np.array(weights) * size, least)
    assert abs(np.linalg.norm(miss) - np.linalg.norm(expected)) < 2e-3
    if total == 900.0:
        assert (rate == 0).any() and (rate > 0).any()  # the bound binds


@pytest.mark.parametrize("seed", [1, 5])
@pytest.mark.parametrize(("weights", "least", "total"), [([0.85, 0.1, 0.05], 1.0, None), ([0.01, 0.01, 0.98], 0.0, 900.0), ([0.34, 0.33, 0.33], 1.0, 1000.0)])
def test_other_seeds_and_targets_out_of_reach(spark, seed, weights, least, total):
    """No rates of that bound have smaller misses; where targets can't be met, the least ones remain."""
    rng = np.random.default_rng(seed)
    tokens, p = rng.integers(5, 60, 40), rng.dirichlet([0.3, 0.2, 0.4], 40)
    soft = spark.createDataFrame([(i, int(n), list(map(float, x))) for i, (n, x) in enumerate(zip(tokens, p, strict=True))], SOFT)
    _, history = mixing.fit_rates(soft, weights, total_tokens=total, least=least)
    size = total or 1.02 * max(tokens @ p / weights)
    expected = brute_rates(tokens, p, np.array(weights) * size, least)
    # plain steps may not be through after so many, so the fit may be better
    assert np.linalg.norm(history[-1]) < np.linalg.norm(expected) + 1e-4
    assert (np.linalg.norm(expected) > 0.4) == (total == 1000.0)


def test_a_domain_whose_rows_are_all_at_the_bound(spark):
    """The first domain has more tokens than its target at the least rates; the second can still be met."""
    soft = spark.createDataFrame([(i, 10, [1.0, 0.0]) for i in range(20)] + [(20 + i, 10, [0.0, 1.0]) for i in range(5)], SOFT)
    rate, history = mixing.fit_rates(soft, [0.5, 0.5], total_tokens=300.0, least=1.0)
    assert abs(history[-1][0] - 0.25) < 1e-4 and abs(history[-1][1]) < 1e-4
    assert {r.rate if r.k < 20 else round(r.rate, 3) for r in soft.withColumn("rate", rate).collect()} == {1.0, 3.0}


def test_an_unsettled_fit_raises(spark):
    soft = spark.createDataFrame([(1, 10, [0.6, 0.4]), (2, 10, [0.4, 0.6])], SOFT)
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(soft, [0.58, 0.42], steps=1)


def test_mixing_meets_its_targets(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    fitted = mixing.mix(docs, mixing.labelled_documents(docs, table(spark, folder, "labels")), mixing.TARGETS).collect()
    sums = {d: sum(r.rate * r.n_tokens * r.posterior[d] for r in fitted) for d in mixing.TARGETS}
    shares = {d: s / sum(sums.values()) for d, s in sums.items()}
    assert all(abs(shares[d] - w) < 0.002 for d, w in mixing.TARGETS.items()), shares
    assert min(r.rate for r in fitted) >= 1 and min(r.copies for r in fitted) >= 1
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    told = [max(r.posterior, key=r.posterior.get) == lang[r.doc_id] for r in fitted if r.n_tokens > 50]
    assert sum(told) / len(told) > 0.9


ROWS = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "e f g", "y"), (3, None, None), (None, "a b e", "y"), (4, "", "x"), (5, "a " * 50_000, "x"), (6, "q r", "other")]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in ("k", "p", "rate", "copy", "n_tokens", "__row", "posterior")})


def test_repeated_rows_are_rows_of_their_own(spark):
    docs = docs_of(spark, ROWS)
    found = mixing.mix(docs, docs, {"x": 0.5, "y": 0.5}).collect()
    assert len(found) == len(ROWS)
    assert [r.n_tokens for r in found if r.doc_id == 1] == [4, 4]
    assert {r.doc_id: r.n_tokens for r in found} == {1: 4, 2: 3, 3: 0, None: 3, 4: 0, 5: 50_000, 6: 2}
    mixed = mixing.mixed_documents(docs, docs, {"x": 0.5, "y": 0.5}, least=1.0)
    assert {r.doc_id for r in mixed.collect()} == {r[0] for r in ROWS}
    assert mixed.columns == [*[c for c in docs.columns if c not in ("n_tokens", "rate", "copy")], "n_tokens", "rate", "copy"]


def test_without_rows_or_labels(spark):
    docs = docs_of(spark, ROWS)
    for labelled in (docs.limit(0), docs.filter("lang = 'other'")):
        found = mixing.mix(docs, labelled, {"x": 0.75, "y": 0.25}).collect()
        assert len(found) == len(ROWS) and all(r.rate == 1 and r.copies == 1 and abs(r.posterior["x"] - 0.75) < 1e-9 for r in found)
    assert mixing.mix(docs.limit(0), docs, {"x": 0.75, "y": 0.25}).count() == 0
    assert mixing.mix(docs.limit(0), docs.limit(0), {"x": 0.75, "y": 0.25}).count() == 0
