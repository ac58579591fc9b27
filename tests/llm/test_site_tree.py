"""Style trees against a brute-force version, where importance alone decides; kinds; hostile pages."""

from __future__ import annotations

import math
import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from watchshelf.llm import site_tree

PAGES = "page_id long, url string, html string"


class Tree(HTMLParser):
    """A plain tree of well-formed pages: [style, place, children and texts]."""

    def __init__(self, page):
        super().__init__()
        self.root = ["", 0, []]
        self.stack = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        style = tag + "".join(f".{v}" for k, v in attrs if k == "class")
        node = [style, sum(1 for x in self.stack[-1][2] if isinstance(x, list) and x[0] == style), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def whole(node):
    return "|".join(whole(x) if isinstance(x, list) else x for x in node[2])


def nodes(node, path=()):
    for x in node[2]:
        if isinstance(x, list):
            own = (*path, (x[0], x[1]))
            yield own, x
            yield from nodes(x, own)


def entropy(counts, m):
    """Of the counts and two further pages of their own, to the base of all pages."""
    size = m + 2
    return -sum(n / size * math.log(n / size) for n in [*counts, 1, 1]) / math.log(size)


def brute(pages, threshold=0.3):
    """pages: page_id -> html without articles. The text of each page, and the importances."""
    trees = {k: Tree(x).root for k, x in pages.items()}
    seen: dict = {}
    for x in set(pages.values()):
        for path, node in nodes(Tree(x).root):
            seen.setdefault(path, []).append((tuple(c[0] for c in node[2] if isinstance(c, list)), whole(node)))
    importance = {}
    for path, shown in seen.items():
        styles, contents = Counter(s for s, _ in shown), Counter(c for _, c in shown)
        g = 0.9 ** len(styles)
        importance[path] = (1 - g) * entropy(styles.values(), len(shown)) + g * entropy(contents.values(), len(shown))

    def text(node, path):
        out = []
        for x in node[2]:
            if isinstance(x, str):
                out += [x.strip()] if x.strip() else []
            elif (own := (*path, (x[0], x[1]))) and (x[0] in ("html", "body") or importance[own] >= threshold):
                out += text(x, own)
        return out

    return {k: " ".join(text(t, ())) for k, t in trees.items()}, importance


def generated(rng, n):
    """A host's pages: a menu, a side box and a last line alike on most pages, a body of changing shape, an edition in two forms."""
    pages = {}
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    for i in range(n):
        menu = "<div class=\"m\"><ul>" + "".join(f"<li>Section {j}</li>" for j in range(5)) + "</ul></div>"
        body = "<div class=\"b\"><h1>" + words(3) + "</h1>" + "".join(f"<p>{words(6)}</p>" for _ in range(rng.randrange(1, 7))) + "<div class=\"note\">Write to the editor</div></div>"
        side = f"<div class=\"s\"><p>Edition {'north' if i % 2 else 'south'}</p></div>" if i % 3 else ""
        pages[i] = f"<html><body>{menu}{body}{side}<div class=\"e\">All pages end so</div></body></html>"
    return pages


@pytest.mark.parametrize("most", [10**9, 0])
def test_importance_alone_decides_by_brute_force(spark, most):
    rng = random.Random(8)
    hosts = {f"h{n}": generated(rng, n) for n in (1, 3, 7, 9, 40)}
    rows = [(1000 * j + i, f"https://{host}/p{i}", page) for j, (host, pages) in enumerate(hosts.items()) for i, page in pages.items()]
    rows += [(9000 + i, "https://h40/copy", hosts["h40"][0]) for i in range(200)]  # copies of one page don't count
    found = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, PAGES), max_broadcast=most).collect()}
    for j, pages in enumerate(hosts.values()):
        expected, _ = brute(pages)
        assert {i: found[1000 * j + i] for i in pages} == expected
    assert "Section" in found[0] and "Section" not in found[4000] and "All pages" not in found[4000] and "editor" not in found[4000]
    assert found[9000] == found[4000] and len(found[4000].split()) >= 9


def test_importances_by_brute_force(spark):
    from watchshelf.llm.common import Workspace

    pages = generated(random.Random(2), 25)
    frame = spark.createDataFrame([("h", x) for x in pages.values()], "host string, html string")
    found = sorted(r.importance for r in site_tree.importances(frame, Workspace(spark, "test")).collect())
    assert len(found) == len(brute(pages)[1])
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(found, sorted(brute(pages)[1].values()), strict=True))


def test_repeated_blocks_go_inside_articles_and_copies_of_articles_stay(spark):
    page = lambda i, own: f"<body><nav>{i}</nav><article><h1>{own} title</h1><p>{own} text</p><p class='x'>Follow us for more</p></article></body>"
    rows = [(i, "https://a/x", page(i, f"own{i}")) for i in range(20)] + [(100 + i, "https://b/x", page(i, "same")) for i in range(50)]
    found = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[i] == f"own{i} title own{i} text" for i in range(20))
    assert all(found[100 + i] == "same title same text Follow us for more" for i in range(50))


def test_names_count_if_all_their_parts_are_listed():
    page = "<article><div class='search-results'>a</div><p class='tags-intro'>b</p><div class='advert'>c</div><div class='comment-list'>d</div><div id='cookie-banner'>e</div><div class='has-sidebar'>f</div></article>"
    assert site_tree.extract(page, ()) == "a b f"


@pytest.mark.parametrize(("page", "text"), [
    ("<p title='a > b'>x</p>", "x"), ('<p title="it\'s">y &amp; z</p>', "y & z"), ("a < b and c<d", "a < b and c"), ("<p>one<p>two<ul><li>i<li>j</ul>", "one two i j"),
    ("x<!-- <p>no</p> -->y", "xy"), ("<script>var a = '<p>'</SCRIPT >after", "after"), ("<div>a</b></div></div>b", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("text <a href='x", "text"),
])
def test_small_pages(page, text):
    assert site_tree.extract(page, ()) == text


@pytest.mark.parametrize("page", ['<a b="' * 10_000, "<p title=\"'\">" * 10_000, "<div>" * 200_000, "<p><ul>" * 50_000, "<div>" * 50_000 + "</b></i>" * 50_000, "<a " * 100_000, "<script>" * 20_000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.monotonic()
    site_tree.extract(page, {1})
    site_tree.page_nodes(page)
    assert time.monotonic() - began < 30
