"""Language-model scoring by the subword lattice likelihood.

A unigram over the pieces of an existing vocabulary and the end of a text weights all segmentations of a text; a forward
recursion in log space sums them, so a score is the log of the text's marginal probability. A piece holds the word marker
in front if at all, so segmentations never cross the beginning of a word: the sum over those of a text is the product of
the sums over those of its words, and each distinct word is computed once.

The vocabularies at hand are lists of merges without probabilities, so the order of the pieces gives their first scores
(rank r: in proportion to 1 / (r + 10)), and rounds of expectation maximisation over all words of the training documents,
each weighted by its count, fit the scores to the corpus. prior_words words of the first scores are added to each round,
so that every piece, and with the byte pieces every text, keeps a probability above 0. The scores of all pieces and of the
end sum to 1. The number of rounds was chosen on a part of the training documents.

Beside that score, word_score is the same with one arc more in the lattice of a word that the training documents have, the
whole word: its count less a discount, n1 / (n1 + 2 n2) from the numbers of words seen once and twice, in proportion to
all tokens. What the discounts leave is the share of the segmentations by pieces.

Texts are dealt into slots of about slot_bytes. A slot lists its distinct words with their training counts; the
global counts and the lattice scores come back to the slot by a join on the word, which has one row for each slot
and word however frequent the word is.

Defined results: null text is empty and has the end token alone; a very long text is one row of work, linear in its
words, and a very long word linear in its bytes; without training documents the vocabulary's own scores hold, with one
end in 100 tokens; rows without a key are training documents like others with their remainder; repeated rows count as
often as they come; an empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
SLOT_BYTES = 8_000_000
MARK = b"\x00"  # stands for the vocabulary's word marker; a word of a text may hold that byte, but not first in a lattice
BASE = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces in the order of the vocabulary, A-Z lower-cased, the word marker as one zero byte; bytes come last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own: dict[bytes, None] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            if "▁" not in piece[1:]:
                own[piece.replace("▁", "\0").encode().lower()] = None
    return list(own) + [bytes([b]) for b in range(256) if bytes([b]) not in own]


def hashes(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of bytes; a substring's hash follows from two of them."""
    out = np.zeros((data.shape[0], data.shape[1] + 1), np.uint64)
    for j in range(data.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + data[:, j] + np.uint64(1)
    return out


class Lattice:
    """Log scores of pieces, and the recursions over many words at once."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.logs, self.tables = logs, []
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(i)
        for size in sorted(by_size):
            ids = np.array(by_size[size], np.int64)
            keys = hashes(np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, size))[:, -1]
            order = np.argsort(keys)
            self.tables.append((size, BASE ** np.uint64(size), keys[order], ids[order]))

    def arcs(self, prefix: np.ndarray, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """start, rows and piece ids of the pieces that end there."""
        for size, power, keys, ids in self.tables:
            if size > end:
                break
            wanted = prefix[:, end] - prefix[:, end - size] * power
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            rows = np.flatnonzero(keys[at] == wanted)
            if len(rows):
                yield end - size, rows, ids[at[rows]]

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Indices of words of similar length, their prefix hashes and lengths (with the marker)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            top = max(8, int(sizes[order[at]] * 1.3))
            to = at + int(np.searchsorted(sizes[order[at:]], top, side="right"))
            to = min(to, at + max(1, 2_000_000 // top))
            own = order[at:to]
            width = int(sizes[own[-1]])
            data = np.frombuffer(b"".join((MARK + words[i]).ljust(width, b"\xff") for i in own), np.uint8).reshape(len(own), width)
            yield own, hashes(data), sizes[own]
            at = to

    def forward(self, prefix: np.ndarray) -> np.ndarray:
        alpha = np.full(prefix.shape, -np.inf)
        alpha[:, 0] = 0
        for end in range(1, prefix.shape[1]):
            for start, rows, ids in self.arcs(prefix, end):
                alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, start] + self.logs[ids])
        return alpha

    def scores(self, words: list[bytes]) -> np.ndarray:
        """The natural log of each word's probability."""
        out = np.empty(len(words))
        for own, prefix, sizes in self.groups(words):
            out[own] = self.forward(prefix)[np.arange(len(own)), sizes]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, on average over segmentations, in words that come so often."""
        out = np.zeros(len(self.logs))
        for own, prefix, sizes in self.groups(words):
            alpha = self.forward(prefix)
            beta = np.full(prefix.shape, -np.inf)
            beta[np.arange(len(own)), sizes] = 0
            total, weight = alpha[np.arange(len(own)), sizes], counts[own]
            for end in range(prefix.shape[1] - 1, 0, -1):
                for start, rows, ids in self.arcs(prefix, end):
                    through = beta[rows, end] + self.logs[ids]
                    beta[rows, start] = np.logaddexp(beta[rows, start], through)
                    used = np.exp(alpha[rows, start] + through - total[rows]) * weight[rows]
                    out += np.bincount(ids, used, minlength=len(out))
        return out


def first_logs(pieces: list[bytes]) -> np.ndarray:
    """Scores from the order of the vocabulary."""
    weight = 1 / (np.arange(len(pieces)) + 10.0)
    return np.log(weight / weight.sum())


def slot_words(slot: pa.Table) -> pa.Table:
    """Distinct words of a slot, each with its count in training documents; texts end in a token of their own, not listed."""
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for data, train in zip(slot.column("data"), slot.column("train").to_pylist(), strict=True):
        seen[train].update((data.as_py() or b"").lower().split())
    words = list(dict.fromkeys(chain(seen[True], seen[False])))
    return pa.table({"slot": pa.array([slot.column("slot")[0].as_py()] * len(words), pa.int64()), "word": pa.array(words, pa.binary()), "n": pa.array([seen[True][w] for w in words], pa.int64())})


def fitted_logs(used: np.ndarray, weight: np.ndarray, ends: float, prior_words: float) -> tuple[np.ndarray, float]:
    """Log scores of the pieces and of the end, from the expected uses of the pieces, their first scores and the number of texts."""
    pieces, end = used + prior_words * weight, ends if ends else 0.01 * (used.sum() + prior_words)
    total = pieces.sum() + end
    return np.log(pieces / total), math.log(end / total)


def lm_scores(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 2, prior_words: float = 1000.0, slot_bytes: int = SLOT_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k, held_out, n_tokens, n_known, train_tokens, base_score, score and word_score (all log10) for each row of docs."""
    spark = docs.sparkSession
    ws = Workspace(spark, "lattice-lm")
    outside = F.crc32(F.coalesce(docs[key].cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    size, ends = docs.agg(F.sum(F.octet_length(docs[text]).cast("long")), F.count_if(~outside)).first()
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / slot_bytes))
    slot = F.pmod(F.xxhash64(docs[key], docs[text]), F.lit(slots))
    rows = docs.select(slot.alias("slot"), docs[key].cast("long").alias("k"), docs[text].cast("binary").alias("data"), (~outside).alias("train"))
    own = ws.save(rows.select("slot", "data", "train").groupBy("slot").applyInArrow(slot_words, "slot long, word binary, n long"), "slot-words")
    words = ws.save(own.groupBy("word").agg(F.sum("n").alias("n")), "words")
    known_tokens, distinct, once, twice = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    total, kinds = known_tokens + ends, distinct + (ends > 0)

    pieces = read_vocabulary(vocabulary)
    weight = np.exp(first_logs(pieces))
    logs, end_log = fitted_logs(np.zeros(len(pieces)), weight, 0, prior_words)
    for _ in range(rounds if total else 0):
        shared = spark.sparkContext.broadcast((pieces, logs))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, used = Lattice(*shared.value), 0
            for b in batches:
                used = used + lattice.expected(b.column("word").to_pylist(), b.column("n").to_numpy().astype(float))
            if isinstance(used, np.ndarray):
                ids = np.flatnonzero(used)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(ids), "n": pa.array(used[ids])})

        parts = words.filter("n > 0").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        used = np.zeros(len(pieces))
        for r in parts.collect():  # one row for each piece of the vocabulary at most
            used[r["piece"]] = r["n"]
        logs, end_log = fitted_logs(used, weight, ends, prior_words)

    shared = spark.sparkContext.broadcast((pieces, logs))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"word": b.column("word"), "n": b.column("n"), "lattice": pa.array(lattice.scores(b.column("word").to_pylist()) / math.log(10))})

    known = ws.save(words.mapInArrow(scored, "word binary, n long, lattice double"), "scored")
    under = total + kinds + 1
    base_end, model_end = math.log10((ends + 1) / under), end_log / math.log(10)
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    left = math.log10(discount * kinds / total) if total else 0.0

    def with_words(counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            whole = np.log10(np.maximum(counts - discount, 0) / max(1, total))
        return np.logaddexp(whole * math.log(10), (left + lattice) * math.log(10)) / math.log(10)

    words_end = float(with_words(np.array([ends]), np.array([model_end]))[0])

    def finish(texts: pa.Table, listed: pa.Table) -> pa.Table:
        at = {w: i for i, w in enumerate(listed.column("word").to_pylist())}
        c, lp = listed.column("n").to_numpy(), listed.column("lattice").to_numpy()
        base, whole = np.log10((c + 1) / under), with_words(c, lp)
        out = []
        for data in texts.column("data"):
            ids = np.fromiter(map(at.__getitem__, (data.as_py() or b"").lower().split()), np.int64)
            out.append((len(ids) + 1, int((c[ids] > 0).sum()) + (ends > 0), float(base[ids].sum()) + base_end, float(lp[ids].sum()) + model_end, float(whole[ids].sum()) + words_end))
        n, k, b, s, w = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pa.table({
            "k": texts.column("k"), "train": texts.column("train"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(k, pa.int64()),
            "base_score": pa.array(b, pa.float64()), "score": pa.array(s, pa.float64()), "word_score": pa.array(w, pa.float64()),
        })

    back = own.select("slot", "word").join(known, "word").select("slot", "word", "n", "lattice")
    done = rows.groupBy("slot").cogroup(back.groupBy("slot")).applyInArrow(finish, "k long, train boolean, n_tokens long, n_known long, base_score double, score double, word_score double")
    return done.select("k", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "word_score")


def op6_lattice_lm(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("k", "doc_id")
