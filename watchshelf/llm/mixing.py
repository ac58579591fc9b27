"""Mixing sources to target weights, with soft membership.

A naive Bayes classifier over hashed words is counted from a labelled table and gives every document a
posterior over the domains (sharpened only with the square root of its length, so that long texts stay soft).
Rates are then fitted so that the expected tokens of each domain, the sum of rate * tokens * posterior, meet the
targets: least squares of the relative misses over rates of at least `least` (0 or more). A step along the gradient
moves a row's rate by its posterior times one number for each domain, so the fit keeps only these numbers, summed over
all steps: a row's rate is 1 less its posterior times them, projected onto the bound. Each pass over all rows sums, for
each domain, what the projected rates reach, and for each two domains what rows share that the bound leaves free; by
these shares the step is scaled (a damped Newton step of the dual problem), since plain steps of projected gradient
need thousands of passes where the bound acts. A slight pull of all rates to 1 settles between equal fits. It bends
the targets a little, and the more the further rates have to go, so it is divided by ten, from where the fit stands,
until the true misses are gone or no longer move. Nothing but the sums reaches the driver. The fit ends with the
targets met or, if the bound keeps them out of reach, with the least misses.

The classifier learns from at most max_labelled labelled documents, drawn by a hash of their keys (a documented bound
on labelled rows; all documents are scored and fitted). Its numbers, buckets * domains of them, travel inside the
plan, so scoring is a projection over whole texts: no join, no row for each word, and no shuffle of texts.

Defined results: null text is empty; an empty text has no tokens and its posterior is the prior; a very long text is
one row of work, linear in its words; labelled rows without a domain, or with one that has no target, are ignored;
targets of domains without any labelled row are left out and the others scaled up; without any labelled row
posteriors are the targets' shares and all rates are 1 (or `least` where that is more); repeated rows are rows of their
own, scored alike; null keys are scored like others; an empty table gives an empty result. Other columns than key, text
and domain are not read, or carried along in one struct, whatever their names. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, Workspace, drawn, table

BUCKETS = 8192
#: The classifier learns from so many labelled documents at most.
MAX_LABELLED = 20_000
#: The pulls of rates to 1, against the squared misses, one after the other.
PULLS = [10.0**-k for k in range(5, 14)]


def _buckets(text: Column, buckets: int) -> Column:
    """The bucket of each word of a text, null for what is none."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), lambda w: F.when(w != "", F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


class Model:
    """Log priors, and for each domain the log shares of the buckets, as columns of doubles that are part of the plan."""

    def __init__(self, domains: list[str], priors: list[float], shares: list[list[float]], buckets: int, trained: bool = True):
        self.domains, self.priors, self.buckets, self.trained = domains, priors, buckets, trained
        self.shares = [F.split(F.lit(",".join(map(repr, x))), ",").cast("array<double>") for x in shares]

    def scored(self, docs: DataFrame, text: str, *keep: Column) -> DataFrame:
        """docs' kept columns with n_tokens and p, the posterior over the domains."""
        read = docs.select(*keep, _buckets(docs[text], self.buckets).alias("__words"))
        known = len(self.domains)
        total = lambda shares: F.aggregate("__words", F.lit(0.0), lambda a, w: a + F.coalesce(F.get(shares, w), F.lit(0.0)))
        sums = [total(m).alias(f"__m{d}") for d, m in enumerate(self.shares)]
        names = [c for c in read.columns if c != "__words"]
        summed = read.select(*names, F.size(F.filter("__words", lambda w: w.isNotNull())).cast("long").alias("n_tokens"), *sums)
        logits = F.array(*[F.lit(self.priors[d]) + F.col(f"__m{d}") / F.sqrt(F.greatest("n_tokens", F.lit(1))) for d in range(known)])
        shifted = summed.select(*names, "n_tokens", logits.alias("__g")).select(*names, "n_tokens", F.transform("__g", lambda x: F.exp(x - F.array_max("__g"))).alias("__g"))
        share = F.aggregate("__g", F.lit(0.0), lambda a, x: a + x)
        return shifted.select(*names, "n_tokens", F.transform("__g", lambda x: x / share).alias("p"))


def labelled_model(labelled: DataFrame, targets: dict[str, float], domain: str = "lang", text: str = "text", buckets: int = BUCKETS) -> Model:
    """Counts the classifier; the counts, at most buckets * domains numbers, are all that the driver gets."""
    domains = sorted(targets)
    rows = labelled.filter(labelled[domain].isin(domains)).select(labelled[domain].alias("domain"), _buckets(labelled[text], buckets).alias("words"))
    rows = Workspace(labelled.sparkSession, "mixing-labelled").save(rows, "rows")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    if not (known := [d for d in domains if d in sizes]):
        # equal shares of the words leave the priors, which are the targets' shares
        return Model(domains, [_log(targets[d] / sum(targets.values())) for d in domains], [[0.0] for _ in domains], buckets, trained=False)
    each = rows.select("domain", F.explode("words").alias("bucket")).filter("bucket IS NOT NULL").groupBy("domain", "bucket").count()
    counts: dict[str, dict[int, int]] = {d: {} for d in known}
    for r in each.groupBy("domain").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("count").alias("counts")).collect():
        counts[r["domain"]] = dict(zip(r["buckets"], r["counts"], strict=True))
    under = {d: sum(counts[d].values()) + 0.5 * buckets for d in known}
    shares = [[_log((counts[d].get(b, 0) + 0.5) / under[d]) for b in range(buckets)] for d in known]
    return Model(known, [_log(sizes[d] / sum(sizes.values())) for d in known], shares, buckets)


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -700.0


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small system of equations, by elimination with pivots."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for j in range(n):
            if j != i:
                part = rows[j][i] / rows[i][i]
                rows[j] = [x - part * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [r[n] / r[i] for i, r in enumerate(rows)]


def fit_rates(soft: DataFrame, weights: list[float], total_tokens: float | None = None, headroom: float = 1.02, least: float = 0.0, steps: int | None = None, tolerance: float = 1e-5) -> tuple[Column, list[list[float]]]:
    """The rate as a column of soft (n_tokens, p), and the relative misses of each pass (the last: of the result).

    total_tokens None: the smallest total that thins no domain, times headroom. steps: raises if so many passes don't suffice.
    """
    domains = range(len(weights))
    tokens, p = F.col("n_tokens"), [F.coalesce(F.get("p", F.lit(d)), F.lit(0.0)) for d in range(len(weights))]
    weights = [w / sum(weights) for w in weights]
    natural = [x or 0.0 for x in soft.agg(*[F.sum(tokens * p[d]).alias(f"n{d}") for d in domains]).first()]
    if total_tokens is None:
        total_tokens = headroom * max((n / w for n, w in zip(natural, weights, strict=True) if w > 0), default=0.0)
    targets = [w * total_tokens for w in weights]
    weight = [max(n, 1.0) ** 2 / max(sum(natural), 1.0) for n in natural]
    history: list[list[float]] = []

    def relative(xs: list[float]) -> list[float]:
        return [x / max(n, 1.0) for x, n in zip(xs, natural, strict=True)]

    def rate_at(trial: list[float]) -> tuple[Column, Column]:
        free = F.lit(1.0) - reduce(Column.__add__, [p[d] * F.lit(trial[d]) for d in domains])
        return F.greatest(F.lit(float(least)), free), free

    def summed(trial: list[float]) -> dict:
        if steps is not None and len(history) >= steps:
            raise RuntimeError(f"rates did not settle in {steps} steps; the relative misses are {history[-1]}")
        rate, free = rate_at(trial)
        reached = [F.sum(rate * tokens * p[d]).alias(f"s{d}") for d in domains]
        shared = [F.sum(F.when(free > least, tokens * p[d] * p[e])).alias(f"g{d}_{e}") for d in domains for e in range(d + 1)]
        area = F.sum(tokens * (rate * free - rate * rate / 2)).alias("area")
        sums = {c: x or 0.0 for c, x in soft.agg(area, *reached, *shared).first().asDict().items()}
        history.append(relative([sums[f"s{d}"] - targets[d] for d in domains]))
        return sums

    at = [0.0 for _ in domains]  # the steps so far
    sums, before = summed(at), None
    for pull in PULLS:
        step, height, slope, share, trial = at, math.inf, 0.0, 1.0, at
        while True:
            miss = [sums[f"s{d}"] - targets[d] for d in domains]
            gradient = [miss[d] - pull * weight[d] * trial[d] for d in domains]
            if max(map(abs, relative(gradient)), default=0.0) <= tolerance:
                at = trial
                break
            # the convex function of the steps whose slope is the gradient; a step that doesn't lower it is halved
            now = sums["area"] + sum(t * x + pull * w * x * x / 2 for t, w, x in zip(targets, weight, trial, strict=True))
            if now > height - 1e-4 * share * slope + 1e-12 * abs(height):
                share /= 2
                if share < 1e-9:  # as far as numbers of this size can tell, at is the lowest point
                    sums = summed(at)
                    break
            else:
                matrix = [[sums[f"g{max(d, e)}_{min(d, e)}"] + (pull * weight[d] if d == e else 0.0) for e in domains] for d in domains]
                at, height, step, share = trial, now, _solved(matrix, gradient), 1.0
                slope = sum(a * b for a, b in zip(gradient, step, strict=True))
            trial = [x + share * y for x, y in zip(at, step, strict=True)]
            sums = summed(trial)
        size = math.hypot(*history[-1])
        if size <= 2 * tolerance or (before is not None and abs(before - size) <= tolerance):
            break
        before = size
    return rate_at(at)[0], history


def _fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain: str, text: str, keep: list[Column], key: str, least: float = 0.0, **options) -> DataFrame:
    """The kept columns with n_tokens, posterior (by domain), rate and copies, the rate rounded up or down by a hash of the row, so that it equals the rate on average."""
    ws = Workspace(docs.sparkSession, "mixing")
    model = labelled_model(labelled, targets, domain, text)
    draw = F.pmod(F.xxhash64(docs[key], docs[text], F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    soft = ws.save(model.scored(docs, text, *keep, draw.alias("__draw")), "posteriors")
    if model.trained:
        rate, _ = fit_rates(soft, [targets[d] for d in model.domains], least=least, **options)
    else:
        rate = F.lit(max(1.0, least))
    fitted = soft.withColumn("rate", rate)
    named = F.map_from_arrays(F.array(*map(F.lit, model.domains)), "p").alias("posterior")
    names = [c for c in soft.columns if c not in ("n_tokens", "p", "__draw")]
    return fitted.select(*names, "n_tokens", named, "rate", F.floor(F.col("rate") + F.col("__draw")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain: str = "lang", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """For each row of docs: its key, n_tokens, posterior (a map), rate and copies. options: those of fit_rates."""
    return _fitted(docs, labelled, targets, domain, text, [docs[key].alias(key)], key, **options)


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain: str = "lang", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Each row of docs as often as its rate says, with n_tokens, rate and copy (1, 2, ...); its own columns of these names are replaced."""
    row = F.struct(*[docs[c] for c in docs.columns if c not in ("n_tokens", "rate", "copy")]).alias("__row")
    fitted = _fitted(docs, labelled, targets, domain, text, [row], key, **options).filter("copies > 0")
    return fitted.select("__row.*", "n_tokens", "rate", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


#: Shares of the mixed tokens by language, the domain of the documents that their texts can tell.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12}


def labelled_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most max_labelled of the documents that the table of labels vouches for, drawn by a hash of their keys."""
    known = docs.select(key).join(labels.select(key), key, "left_semi")
    return docs.join(F.broadcast(drawn(known, key, max_labelled)), key, "left_semi")


def op2_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_documents(docs, table(spark, sf_dir, "labels")), TARGETS)
