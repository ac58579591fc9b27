"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web texts train a logistic model on counts of the text and on its hashed
words and word pairs: the non-negative unbiased risk, prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)), is minimised
by gradient steps; when the second part falls below zero, its gradient is followed backwards until it no longer does.

The class prior is estimated without any negative label. Two first models, each fitted on one half of both samples to tell
positives from unlabelled texts, score the other halves; among the most certain scores nearly all unlabelled texts are
positive, so the least ratio of the two shares above a score (with its sampling error added) bounds the prior from above.

The fit uses at most max_labelled positives and max_unlabelled unlabelled documents, drawn by a hash of their key
(documented bounds); only drawn keys are ever broadcast or sent to the driver, never texts. All documents are then
scored where they are, without a shuffle.

Inputs of a score come from the whole text alone, however long. Defined results: null text is scored as empty; if there
is no trusted positive every score is 0.5; documents with contradicting labels count as not positive; labels without a
document, or null, are ignored; without unlabelled documents the labelled ones stand in, their labels unseen; repeated
rows are scored alike; rows without a key are scored but not learnt from; columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, table

FOLDS = 5
THRESHOLD = 0.3
MAX_LABELLED, MAX_UNLABELLED = 10_000, 10_000
#: Columns for hashed words, and as many for pairs of words.
HASHED = 64
MARKS = np.frombuffer(b"#$%&*<>|@^~{}[]\\_=+", np.uint8)
BLANKS = np.frombuffer(b" \t\n\r\v\f", np.uint8)


def counted(words: list[bytes], data: bytes) -> list[float]:
    """Ratios that mark natural prose or junk, each between about 0 and 1."""
    n = len(words)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = max(1, len(data) - int(count[BLANKS].sum()))
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    distinct = Counter(words)
    triples = set(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    ratio = lambda a, b: a / max(1, b)
    return [
        ratio(int(count[MARKS].sum()), solid), min(1.0, ratio(int(count[33]), n)), min(1.0, ratio(int(count[124]), n)), ratio(upper, upper + lower), ratio(digits, solid),
        ratio(int(count[128:].sum()), solid), min(1.0, ratio(int(count[44] + count[46]), n)), math.log1p(len(distinct)) / math.log1p(n), ratio(sum(map(eq, words, words[1:])), n - 1),
        1 - ratio(len(triples), n - 2) if n > 2 else 0.0, ratio(distinct.most_common(1)[0][1], n), 1 - ratio(len(set(lines)), len(lines)), min(1.0, solid / n / 20),
        min(1.0, max(map(len, words)) / 100), min(1.0, math.log1p(ratio(n, len(lines))) / 7), math.log1p(n) / 12, float(n < 5), 0.0,
    ]


def features(data: bytes) -> np.ndarray:
    """The counted ratios, then the square roots of the shares that hashed words and pairs of words have in the text."""
    words = data.split()
    out = np.zeros(len(NAMES) + 2 * HASHED, np.float32)
    out[: len(NAMES)] = counted(words, data)
    if words:
        hashed = np.fromiter(map(xxhash.xxh32_intdigest, data.lower().split()), np.uint64, len(words))
        pairs = (hashed[1:] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        for at, values in ((len(NAMES), hashed), (len(NAMES) + HASHED, pairs)):
            if len(values):
                out[at : at + HASHED] = np.sqrt(np.bincount((values % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) / len(values))
    return out


NAMES = ["marks", "bangs", "pipes", "upper", "digits", "beyond_ascii", "stops", "variety", "stutter", "repeats", "top_word", "repeated_lines", "word_length", "longest", "line_length", "length", "tiny", "empty"]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive and the negative part of the unbiased risk under the logistic loss, and their gradients; the last column of p and u is 1."""
    gp, gu = p @ w, u @ w
    positive, negative = prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    return positive, negative, -prior * (sigmoid(-gp) @ p) / len(p), (sigmoid(gu) @ u) / len(u) - prior * (sigmoid(gp) @ p) / len(p)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 2.0) -> np.ndarray:
    """Weights and, last, the bias: minimises the non-negative risk over standardised features, folded back to the features as they are.

    Weights decay by `decay` divided by the number of rows, as under a prior of fixed width, so small samples don't overfit.
    """
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), both.std(0) + 0.02
    p, u = (np.hstack([(x - mean) / spread, np.ones((len(x), 1), np.float32)]).astype(np.float32) for x in (positive, unlabelled))
    w, first, second = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    bias = np.arange(len(w)) == len(w) - 1
    for k in range(1, steps + 1):
        _, negative, up, down = risk(w.astype(np.float32), p, u, prior)
        grad = np.where(bias, 0, decay / len(both) * w) + (up + down if negative >= 0 else -down)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    scaled = w[:-1] / spread
    return np.append(scaled, w[-1] - scaled @ mean)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from features alone: the least ratio of the shares beyond a score, on rows that the scores weren't fitted on."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    halves = []
    for h in (0, 1):
        model = fit(positive[h::2], unlabelled[h::2], 0.5, steps=150)
        halves.append([x[1 - h :: 2] @ model[:-1] + model[-1] for x in (positive, unlabelled)])
    p, u = (np.sort(np.concatenate(x)) for x in zip(*halves, strict=True))
    cuts = np.unique(p)
    above_p, above_u = ((len(x) - np.searchsorted(x, cuts)) / len(x) for x in (p, u))
    error = math.sqrt(math.log(4 / 0.1) / 2 / len(u)) + math.sqrt(math.log(4 / 0.1) / 2 / len(p))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _measured(text: Column) -> Column:
    """The features of each whole text as bytes, which reach the driver without an object for each number."""

    @F.pandas_udf("binary")
    def measure(data: pd.Series) -> pd.Series:
        return data.map(lambda x: features(x or b"").tobytes())

    return measure(text.cast("binary"))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def _matrix(rows: DataFrame) -> np.ndarray:
    """The features of a drawn sample, in the order of a hash of the key."""
    found = rows.select("k", _measured(F.col("text")).alias("x")).orderBy(F.xxhash64("k", F.lit("order")), "k", "x").toArrow()
    return np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, len(NAMES) + 2 * HASHED)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> np.ndarray | None:
    """The model's weights, or None without a trusted positive. Reads labels of rows that aren't held out."""
    own = labels.filter(labels[label].isNotNull() & ~held_out(labels[key])).groupBy(labels[key].alias("k")).agg(F.min(label).alias("y"))
    rows = docs.select(docs[key].alias("k"), docs[text].alias("text")).filter(F.col("k").isNotNull() & ~held_out(F.col("k")))
    keys = rows.select("k")
    chosen = lambda some, most: rows.join(F.broadcast(drawn(some, "k", most)), "k", "left_semi")
    positive = _matrix(chosen(keys.join(own.filter("y = 1"), "k", "left_semi"), max_labelled))
    if not len(positive):
        return None
    unlabelled = _matrix(chosen(keys.join(labels.select(labels[key].alias("k")), "k", "left_anti"), max_unlabelled))
    if not len(unlabelled):
        unlabelled = _matrix(chosen(keys.join(own, "k", "left_semi"), max_unlabelled))
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(text: Column, model: np.ndarray | None) -> Column:
    """The model's probability of label 1 for each whole text."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in parts:
            x = np.array([features(d or b"") for d in data]).reshape(len(data), len(model) - 1)
            yield pd.Series(sigmoid(x @ model[:-1] + model[-1]))

    return scored(text.cast("binary"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that score at least the threshold."""
    return docs.filter(score(docs[text], train(docs, labels, text, key)) >= threshold)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), train(docs, table(spark, sf_dir, "labels"))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
