"""Each operator against a brute-force version, SQL, a round trip or held-out labels; and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from watchshelf.llm import chat, decontaminate, lattice_lm, line_dedup, line_rules, mixing, quality, similar, simhash, site_tree, suffix_dedup
from watchshelf.llm.common import Workspace, table
from watchshelf.llm.components import components
from watchshelf.llm.queries import ORACLES, QUERIES

from conftest import DATA, rows_of, rows_of_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns.
CLASHING = ("k", "t", "data", "fp", "slot", "n_lines", "n_removed", "rate", "copy", "words", "row", "w", "train", "h", "component")


def docs_of(spark, *texts, clash=False, **columns):
    rows = [(i, x, "en", "s", None) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else df


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    """Tables with empty and long texts, ties, copies, repeated lines and odd characters; ids are unique and not null."""
    folder = tmp_path_factory.mktemp("edge")
    line = "one two three four five six seven eight nine ten eleven"
    texts = [
        None, "", " \t\n\r\x0b\x0c", "word", line, line, line.upper(), "\n".join([line] * 7), "a\nb\nc\na\nb\nc\nd", "a\n\n b \nc\nx\na\nb\t\nc", "#*$%&|<> É é ß 漢字\x00 x", ("lorem ipsum " * 700),
        "aaaa " * 50, line + "\n" + "x" * 70_000, "Twelve THIRTEEN, fourteen; fifteen", "\\<|im_end|>", "a b", "A B",
    ]
    rows = [(i, x, "en" if i % 2 else None, None if i % 5 == 0 else "host", None) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, line), (2, "Twelve thirteen"), (3, None), (4, ""), (5, "a b"), (6, "a b"), (7, "lorem ipsum " * 6)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(99, 1, 0), (4, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "http://a/x", "<p>x &amp; y"), (2, None, None), (3, "http://a/y", ""), (4, "", "<div><p>unclosed <b>bold</p><p>next"), (5, "http://a/z", "<" * 5000), (6, "http://b", "<div>" * 3000 + "deep")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\n<\\|x|>"), (2, 0, "assistant", ""), (3, 0, "user", "é漢"), (3, 0, "user", "é漢"), (3, 1, None, "n"), (4, 5, "assistant", "a"), (4, 9, "assistant", "b"), (None, 0, "user", "no id"), (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 50_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("edge", [False, True])
def test_same_as_sql(spark, edge_dir, name, edge):
    folder = edge_dir if edge else str(DATA)
    assert rows_of(QUERIES[name](spark, folder)) == rows_of_sql(ORACLES[name], folder)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("op11_", "op12_", "op13_"))))  # their rows aren't documents; they have such tests of their own
def test_nulls_repeats_and_empty_tables(spark, edge_dir, tmp_path, name):
    """Null keys and repeated rows don't crash, and give as many rows as the contract has; empty tables give no documents."""
    odd, none = tmp_path / "odd", tmp_path / "none"
    for n in ("documents", "benchmark", "labels", "pages", "conversations"):
        df = table(spark, edge_dir, n)
        first = df.columns[0]
        twice = df.unionAll(df.limit(6)).unionAll(df.limit(4).withColumn(first, F.lit(None).cast("long"))).withColumns({c: F.lit("clash") for c in CLASHING})
        twice.write.parquet(f"{odd}/{n}.parquet")
        df.limit(0).write.parquet(f"{none}/{n}.parquet")
    own = spark.read.parquet(f"{odd}/{'pages' if name.startswith('op7') else 'conversations' if name.startswith('op8') else 'documents'}.parquet")
    n_rows = own.select("conv_id").distinct().count() + 1 if name.startswith("op8") else own.count()
    assert QUERIES[name](spark, str(odd)).count() == n_rows
    assert QUERIES[name](spark, str(none)).count() == (1 if name.startswith("op8") else 0)


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("edge", [False, True])
def test_simhash_by_brute_force(spark, edge_dir, edge):
    folder = edge_dir if edge else str(DATA)
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    prints = {k: brute_fingerprint(x) for k, x in docs.items()}
    roots = brute_components(docs, [(a, b) for a, b in itertools.combinations(sorted(docs), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, folder).collect()}
    assert found == {k: (f"{prints[k]:016x}", roots[k]) for k in docs}


@pytest.mark.parametrize("block", [1024, 16, 3])
def test_covering_tables_miss_no_link(spark, block):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        for n in (1, 2, 3, 4, 5):
            q = p
            for b in rng.sample(range(64), n):
                q ^= 1 << b
            prints.add(q)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, node long")
    ws = Workspace(spark, "test")
    found = {r.node: r.root for r in components(simhash.near_links(df, ws, block=block), ws).collect()}
    expected = brute_components(range(len(prints)), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert {i: found.get(i, i) for i in expected} == expected


@pytest.mark.parametrize("level", [0, 1, 2])
def test_every_pair_within_the_radius_shares_a_table(level):
    masks = simhash.masks(3, level)
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        flips -= 1 << 64 if flips >> 63 else 0
        assert any(flips & m == 0 for m in masks)


def test_levels_of_tables_leave_few_free_positions():
    free = [64 - ((a | b | c) & ((1 << 64) - 1)).bit_count() for a, b, c in itertools.product(*(simhash.masks(3, level) for level in range(3)))]
    assert max(free) <= 16, max(free)


def brute_suffix(docs, length=50):
    least = {}
    for k, x in docs:
        for i in range(len(x) - length + 1):
            least[x[i : i + length]] = min(k, least.get(x[i : i + length], k))
    out = {}
    for k, x in docs:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if least[x[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[k] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def repetitive():
    """Texts of few letters with shared passages, some between differing surroundings, in a random order of keys; and what brute force makes of them."""
    rng = random.Random(3)
    shared = ["".join(rng.choice("ab c") for _ in range(rng.choice([49, 50, 51, 80, 400]))) for _ in range(12)]
    texts = ["", None, "x" * 49, "x" * 50, "x" * 300, "é" * 60, "x" * 51]
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[20], texts[20] + "tail"]
    texts += [f"{rng.random()} {shared[-1][:60]} {rng.random()}" for _ in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    return rows, brute_suffix([(k, (x or "").encode()) for k, x in rows])


def suffix_results(spark, rows, **options):
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), slot_bytes=700, **options).collect()
    return {r.k: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found}


@pytest.mark.parametrize(("batches", "hot"), [(1, 1000), (4, 3), (3, 1)])
def test_suffix_dedup_by_brute_force(spark, repetitive, batches, hot):
    rows, expected = repetitive
    assert suffix_results(spark, rows, batches=batches, hot=hot) == expected


def test_sixteen_batches_merge_as_a_binary_counter_does(spark, repetitive, monkeypatch):
    rows, expected = repetitive
    seen, add = [], suffix_dedup.SuffixIndex.add

    def watched(self, arrays, more=True):
        out = add(self, arrays, more)
        seen.append(sorted(self.levels))
        return out

    monkeypatch.setattr(suffix_dedup.SuffixIndex, "add", watched)
    assert suffix_results(spark, rows, batches=16) == expected
    assert seen[:15] == [[i for i in range(4) if n >> i & 1] for n in range(1, 16)]


def test_colliding_hashes_are_settled_by_the_bytes(spark, repetitive, monkeypatch):
    rows, expected = repetitive
    hashed = suffix_dedup._hashed
    monkeypatch.setattr(suffix_dedup, "_hashed", lambda mixed, at, length, salt: hashed(mixed, at, length, salt) & np.uint64(3 if salt else 0xFFFFFFFFFFFFFFFF))
    assert suffix_results(spark, rows, batches=2) == expected


def test_arrays_are_in_byte_order():
    texts = [("".join(random.Random(i).choice("abc") for _ in range(300))).encode() for i in range(4)]
    runs = suffix_dedup.Runs(texts, 50, 3)
    for _, own in runs.by_part():
        entries = [x.astype(">u8").tobytes() for x in runs.keys[own]]
        assert entries == sorted(set(entries)) and all(any(e in t for t in texts) for e in entries)
        assert np.array_equal(suffix_dedup.unpacked_keys(suffix_dedup.packed_keys(runs.keys[own])), runs.keys[own])


def test_suffix_dedup_of_the_documents(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, str(DATA), "documents").collect()]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_suffix_dedup"](spark, str(DATA)).collect()}
    assert found == brute_suffix(docs)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    found = QUERIES["op5_quality"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    judged = [(r.score, labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in judged if y], [s for s, y, _ in judged if not y]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    accuracy = sum(y == p for _, y, p in judged) / len(judged)
    print(f"auc {auc:.4f} accuracy {accuracy:.4f} of {len(judged)}")
    assert auc > 0.95 and accuracy > 0.9


def test_the_risk_and_its_gradient_by_brute_force():
    rng = np.random.default_rng(2)
    p, u, w, prior = np.hstack([rng.normal(1, 1, (30, 4)), np.ones((30, 1))]), np.hstack([rng.normal(0, 2, (50, 4)), np.ones((50, 1))]), rng.normal(0, 1, 5), 0.4

    def brute(w):
        loss = lambda x, y: sum(math.log1p(math.exp(-y * sum(a * b for a, b in zip(r, w, strict=True)))) for r in x) / len(x)
        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    positive, negative, up, down = quality.risk(w, p, u, prior)
    assert np.allclose((positive, negative), brute(w))
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        slopes = (np.array(brute(w + step)) - np.array(brute(w - step))) / 2e-6
        assert np.allclose((up[i], down[i]), slopes, atol=1e-5)


def test_the_prior_is_estimated_from_features_alone():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        good, bad = rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3))
        n = int(share * 3000)
        unlabelled = rng.permutation(np.concatenate([good[3000 : 3000 + min(n, 1000)], rng.normal(2, 1, (max(0, n - 1000), 3)), bad[: 3000 - n]])).astype(np.float32)
        assert abs(quality.estimated_prior(good[:3000].astype(np.float32), unlabelled) - share) < 0.05


def test_quality_without_positives_is_undecided(spark):
    docs = docs_of(spark, "some text", None, "more")
    none = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert docs.select(quality.score(F.col("text"), None)).distinct().collect()[0][0] == 0.5
    assert quality.keep_good(docs, none).count() == 3


def test_lattice_by_brute_force():
    pieces = [b"\0", b"\0a", b"a", b"b", b"ab", b"ba", b"\0ab"] + [bytes([b]) for b in range(1, 97)]
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))
    at = dict(zip(pieces, logs, strict=True))

    def mass(word):
        return 1.0 if not word else sum(math.exp(at[word[:n]]) * mass(word[n:]) for n in range(1, len(word) + 1) if word[:n] in at)

    words = [b"a", b"ab", b"abba", b"babab", b"!", b"aaaaaaaaaaab"]
    lattice = lattice_lm.Lattice(pieces, logs)
    assert np.allclose(lattice.scores(words), [math.log(mass(b"\0" + w)) for w in words])
    # the expected use of pieces covers each word's bytes exactly once
    used = lattice.expected(words, np.ones(len(words)))
    assert math.isclose(sum(n * len(p) for n, p in zip(used, pieces, strict=True)), sum(len(w) + 1 for w in words))


def test_lm_against_counts(spark):
    folder = str(DATA)
    docs = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    tokens = {k: [w.lower() for w in x.encode().split()] + [None] for k, x in docs.items()}
    counts: dict = {}
    for k, own in tokens.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in own:
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in QUERIES["op6_lattice_lm"](spark, folder).collect()}
    assert set(found) == set(docs)
    for k, own in tokens.items():
        r = found[k]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(w in counts for w in own), total, zlib.crc32(str(k).encode()) % 7 == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def segmentations(text, at):
    """All ways to write the text, markers included, as pieces."""
    return [[]] if not text else [[text[:n], *rest] for n in range(1, len(text) + 1) if text[:n] in at for rest in segmentations(text[n:], at)]


def test_expected_uses_by_brute_force():
    pieces = [b"\0", b"\0a", b"a", b"b", b"ab", b"ba", b"\0ab"]
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(len(pieces))))
    at = dict(zip(pieces, logs, strict=True))
    words, counts = [b"ab", b"abba", b"a"], np.array([3.0, 1.0, 7.0])
    used = dict.fromkeys(pieces, 0.0)
    for word, n in zip(words, counts, strict=True):
        ways = segmentations(b"\0" + word, at)
        weights = [math.exp(sum(at[p] for p in way)) for way in ways]
        for way, weight in zip(ways, weights, strict=True):
            for p in way:
                used[p] += n * weight / sum(weights)
    assert np.allclose(lattice_lm.Lattice(pieces, logs).expected(words, counts), list(used.values()))


@pytest.mark.parametrize("rounds", [0, 2])
def test_scores_are_sums_over_segmentations_of_whole_texts(spark, rounds):
    texts = ["the cat sat", "The CAT\n sat on", "", None, "a", "né 漢"] * 4
    docs = dict(enumerate(texts))
    found = {r.k: r for r in lattice_lm.lm_scores(docs_of(spark, *texts, clash=True), rounds=rounds).collect()}
    pieces = lattice_lm.read_vocabulary(lattice_lm.VOCABULARY)
    weight = np.exp(lattice_lm.first_logs(pieces))
    logs, end = lattice_lm.fitted_logs(np.zeros(len(pieces)), weight, 0, 1000.0)
    training = [x for k, x in docs.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    for _ in range(rounds):
        at, used = dict(zip(pieces, logs, strict=True)), dict.fromkeys(pieces, 0.0)
        for x in training:
            for word in (x or "").encode().lower().split():
                ways = segmentations(b"\0" + word, at)
                weights = [math.exp(sum(at[p] for p in way)) for way in ways]
                for way, w in zip(ways, weights, strict=True):
                    for p in way:
                        used[p] += w / sum(weights)
        logs, end = lattice_lm.fitted_logs(np.array(list(used.values())), weight, len(training), 1000.0)
    at = dict(zip(pieces, logs, strict=True))
    assert math.isclose(np.exp(logs).sum() + math.exp(end), 1)
    for k, x in docs.items():
        whole = b"".join(b"\0" + w for w in (x or "").encode().lower().split())
        mass = sum(math.exp(sum(at[p] for p in way)) for way in segmentations(whole, at))
        assert math.isclose(found[k].score, (math.log(mass) + end) / math.log(10), rel_tol=1e-9), k


def test_lm_probabilities_sum_to_one(spark):
    """Of texts of one word each, with all words seen and some unseen: both scores stay below 1 in sum."""
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "dogs and cats", "the mat"] * 3
    seen = sorted({w for x in texts for w in x.split()})
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2]
    alone = ["", *seen, *"bcdefghijklmnopqrstuvwxyz", "zebra", "catdog"]
    training = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(k, x) for k, x in zip(training, texts, strict=False)] + list(zip(ids, alone, strict=False))
    found = {r.k: r for r in lattice_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for name in ("score", "word_score"):
        end = found[ids[0]][name]
        mass = [10 ** (found[k][name] - end) for k in ids[1 : len(alone)]]
        assert 0.1 < sum(mass) + 10**end < 1


def test_held_out_figures(spark):
    """Prints the figures that the README gives: the score by pieces alone stays behind the base, whole words in the lattice make up most of it."""
    rows = [r for r in QUERIES["op6_lattice_lm"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.n_tokens > 1]
    for name, some in (("all words known", [r for r in rows if r.n_known == r.n_tokens]), ("some words unknown", [r for r in rows if r.n_known < r.n_tokens])):
        tokens = sum(r.n_tokens for r in some)
        pieces, words, base = (sum(r[c] for r in some) / tokens for c in ("score", "word_score", "base_score"))
        print(f"{name}: {len(some)} texts, pieces {pieces:.3f}, with words {words:.3f}, base {base:.3f} a token")
        assert pieces < words < 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-banner">We use cookies</div><div class="content"><article><h1>Title {n}</h1><p>First &lt;b&gt; <b>bold</b>
  text {n}&nbsp;&#233;.</p><aside>Related</aside><p>Second<br>line of {n}</p><div class="advert">Buy</div></article><form><input>Search</form></div>
<div class="x1">Shared boilerplate of the site</div><div class="comments"><p>Nice!</p></div><script>var a = "<p>no</p>";</script><footer>Imprint</footer></body></html>"""


def test_pages_lose_what_is_no_article(spark):
    rows = [(i, f"https://host/{i}", PAGE.format(n=i)) for i in range(12)]
    found = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Title {i} First <b> bold text {i} é. Second line of {i}" for i in range(12)}


def test_low_importance_branches_go(spark):
    body = lambda i: f"<html><body><div class='a'><p>{'unique words ' + str(i)}</p></div><div class='b'><p>The same on each page</p></div></body></html>"
    rows = [(i, f"https://host/{i}", body(i)) for i in range(12)]
    found = site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {f"unique words {i}" for i in range(12)}


def brute_paths(nodes):
    parent = dict(nodes)
    leaves = set(parent) - {p for n, p in nodes if p in parent}
    out = {}
    for leaf in leaves:
        path, at = [], leaf
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        out[leaf] = path
    return out


def test_reply_trees_by_brute_force(spark):
    rng = random.Random(5)
    nodes = [(0, None)] + [(i, rng.randrange(i)) for i in range(1, 60)] + [(100, 999)]
    scores = {n: rng.random() for n, _ in nodes}
    expected = brute_paths(nodes)
    rows = [(1, n, p, "assistant" if n % 2 else "user", f"text {n}", scores[n]) for n, p in nodes]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found = chat.conversations_of(messages, top=3).orderBy("rank").collect()
    best = sorted(expected, key=lambda x: (-sum(scores[n] for n in expected[x]) / len(expected[x]), -len(expected[x]), x))[:3]
    assert [r.leaf for r in found] == best
    for r in found:
        assert r.formatted == "".join(f"<|im_start|>{'assistant' if n % 2 else 'user'}\ntext {n}<|im_end|>\n" for n in reversed(expected[r.leaf]))


def test_cycles_belong_to_no_path(spark):
    messages = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (2, 1, None, "user", "c", None)], "tree long, node long, parent long, role string, text string, score double")
    assert [r.tree for r in chat.conversations_of(messages).collect()] == [2]


def test_templates_read_back(spark):
    texts = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "a\n<|im_start|>user\nb", "", "<<||>>", "\\<|"]
    rows = [(i, 0, "user", x) for i, x in enumerate(texts)] + [(i, 1, "a%0A\nb<|", x) for i, x in enumerate(texts)]
    messages = chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = chat.conversations_of(messages).withColumn("read", chat.read_back(F.col("formatted"))).collect()
    assert {r.tree: [tuple(x) for x in r.read] for r in found} == {i: [("user", x), ("a%0A\nb<|", x)] for i, x in enumerate(texts)}
    assert all(r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 2 for r in found)


def test_spans_are_cut(spark):
    docs = docs_of(spark, "Intro, words. One two three four five six seven eight nine ten! Rest.", "nothing here", None, clash=True)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, mode="spans").collect()}
    assert cut == {0: "Intro, words. Rest.", 1: "nothing here", 2: None}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    shuffled = decontaminate.contamination(docs, bench, max_broadcast=0).filter(F.size("hit") > 0).collect()
    assert [(r.k, sorted(r.hit), r["items"]) for r in shuffled] == [(0, list(range(2, 12)), [1])]


def test_line_dedup_keeps_other_columns(spark):
    docs = docs_of(spark, "a\nb\nc\nrest", "x\na\nb\nc", None, clash=True)
    found = line_dedup.line_dedup(docs)
    assert {r.doc_id: (r.text, r.n_removed, r.k) for r in found.collect()} == {0: ("a\nb\nc\nrest", 0, "clash"), 1: ("x", 3, "clash"), 2: ("", 0, "clash")}


def test_line_rules_reject_depleted_documents(spark):
    foot = "Terms and conditions of this web site apply to every reader"
    texts = [f"{foot}\nA sentence of its own with number {i} and a few more words to read here" for i in range(20)] + [f"{foot}\nshort {i} text" for i in range(5)]
    found = {r.doc_id: r for r in line_rules.line_rules(docs_of(spark, *texts, clash=True)).collect()}
    assert all(found[i].kept and found[i].n_line_words == 11 for i in range(20))
    assert not any(found[i].kept or found[i].base_failed for i in range(20, 25))


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline

    folder = str(DATA)
    docs = table(spark, folder, "documents")
    ws = Workspace(spark, "test-pipeline")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = ws.save(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "quality":
            good = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
            assert docs.join(good, "doc_id").count() - out.join(good, "doc_id").count() <= 1
        if name == "near_duplicates":
            assert out.count() == similar.groups(docs).select("root").distinct().count()
        if name == "benchmark":
            hit = decontaminate.contamination(out, table(spark, folder, "benchmark")).filter(F.size("hit") > 0)
            assert hit.isEmpty()
        if name == "mixing":
            assert out.select("doc_id").distinct().count() == counts[-1]
        docs = out
        counts.append(out.select("doc_id").distinct().count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(docs)
