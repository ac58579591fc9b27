"""HTML extraction with site style trees.

Pages become trees of block elements. Pages of one host are merged into a style tree: a node is an element's style (tag
and classes, digits made alike) and its place (how many siblings of that style come before it) below its parent's node.
For each node the tree counts how many pages show each presentation there (the sequence of its children's styles) and
each content (all text of the branch). With two further pages assumed that have a presentation and content of their own,
which keeps nodes of few pages important, both importances are the entropy of these counts, to the base of the number of
pages: 0 where all pages are alike, 1 where all differ. The importance of the node is
(1 - g) * presentation + g * content with g = 0.9 ^ (number of presentations). From the top down, branches whose
importance is below the threshold are removed from each page, in articles too; only html, body, article and main
themselves stay, and their branches are judged. Pages count once for each distinct article (outside of articles: for
each distinct html), so copies of a page or of an article don't make it unimportant.

The tree can't tell menus and adverts that differ from page to page from content, since entropy is all it has. So
elements that are never part of an article go by their kind as well (fixed lists of elements, roles and names below; a
name counts if all its parts are on the lists), and if a page has article or main elements only these are read.

Counts are combined before they are shuffled by host and node, so a host of any size is no single group. What comes back
to the pages are the topmost low nodes; they are broadcast while they take at most max_broadcast bytes, beyond that
they are joined to the nodes that each page has.

Defined results: null html is empty and gives empty text; a null url is a host of its own; tags cut off at the end
are dropped, unclosed elements end with their parents, stray end tags are ignored; repeated rows are kept, null keys are
carried along; the work for a very long or deep page grows in proportion to its length; empty tables give empty results.
Columns of the input other than key, url and page are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, per_batch, same, table

# Elements and names by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template iframe textarea title head nav footer aside form button select option input object canvas svg math dialog menu map audio video applet frameset noframes datalist".split())
NEVER_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disclaimer disqus footer gdpr header hidden login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related recommended replies reply responses search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Parts that names of such elements may have besides.
PLAIN_PARTS = frozenset("area article bar block box container entry form group inner item items left link links list main outer page panel post reader right section site slot sticky thread top bottom unit user wrap wrapper".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}
}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
KEPT = frozenset("html body article main".split())

BARRIERS = frozenset("html body article main div section td th li button".split())
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
OPEN_QUOTE = re.compile(r"""=\s*(["'])""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PARTS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
PRIOR_PAGES = 2
#: Bytes of hosts and low nodes that a broadcast may hold.
MAX_BROADCAST = 30_000_000


class Node:
    __slots__ = ("children", "digest", "key", "never", "path", "tag", "texts", "within")

    def __init__(self, tag: str, key: str, path: int, never: bool, within: bool):
        self.tag, self.key, self.path, self.never, self.within, self.digest = tag, key, path, never, within, 0
        self.children: dict[str, list[Node]] = {}
        self.texts: list[Node | str | None] = []  # in page order: children and texts; None is a block boundary


def _named(value: str, inside: bool) -> bool:
    """Whether a class or id names what is never part of an article; headers belong to it inside of one."""
    parts = PARTS.findall(value)
    listed = [x for x in parts if x in NEVER_NAMED and not (inside and x == "header")]
    return bool(listed) and all(x in NEVER_NAMED or x in PLAIN_PARTS for x in parts)


def _look(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """An element's style, and whether its kind is never part of an article."""
    key, never = tag, tag in NEVER or tag == "header" and not inside
    if tag in ("html", "body", "main"):
        return key, False
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                never = never or any(_named(own, inside) for own in value.split())
                if name == "class" and value:
                    key += "." + DIGITS.sub("0", ".".join(value.split()))
            elif name == "role":
                never = never or value in NEVER_ROLES
            elif name == "style":
                never = never or "display:none" in value.replace(" ", "")
            else:
                never = never or value != "false"
    return key, never


def tokens(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end) for each text, opening ("<") and closing ("/") tag, each character looked at a few times at most."""
    at, size = 0, len(text)
    while at < size:
        start = text.find("<", at)
        after = text[start + 1 : start + 2]
        while start >= 0 and not (after.isascii() and after.isalpha() or after in ("/", "!", "?")):
            start = text.find("<", start + 1)
            after = text[start + 1 : start + 2]
        if start < 0:
            yield "", text[at:], "", size
            return
        if start > at:
            yield "", text[at:start], "", start
        if text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        end = text.find(">", start)
        if end < 0:
            return  # a tag cut off
        inner = text[start + 1 : end]
        if after not in ("/", "!", "?") and (inner.count('"') % 2 or inner.count("'") % 2) and (quote := OPEN_QUOTE.search(QUOTED.sub("", inner))):
            # a quoted value that holds this >: it ends with the next quote, if that comes before the next tag
            following = text.find("<", end)
            shut = text.find(quote[1], end, following if following >= 0 else size)
            if shut >= 0 and (further := text.find(">", shut, following if following >= 0 else size)) >= 0:
                end = further
                inner = text[start + 1 : end]
        at = end + 1
        name = NAME.match(inner, 1 if after == "/" else 0)
        if name and after not in ("!", "?"):
            yield "/" if after == "/" else "<", name[0].lower(), inner[name.end() :], at
            if after != "/" and name[0].lower() in RAW:
                at = yield from _raw(text, name[0].lower(), at)


def _raw(text: str, tag: str, at: int) -> Iterator[tuple[str, str, str, int]]:
    """Skips the content of a script and the like, and gives its end tag; returns where to go on."""
    shut = re.compile(f"</{tag}", re.I).search(text, at)
    end = text.find(">", shut.start()) + 1 if shut else 0
    yield "/", tag, "", end or len(text)
    return end or len(text)


def parse(text: str) -> Node:
    """The tree of a page's block elements; inline elements are transparent unless they are adverts and the like."""
    root = Node("", "", 0, False, False)
    stack, opened, ps, barriers = [root], Counter(), [], []

    def shut(depth: int) -> None:
        """Closes all elements from that depth on."""
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1
        for marks in (ps, barriers):
            while marks and marks[-1] >= depth:
                marks.pop()

    for kind, name, attributes, _ in tokens(text):
        top = stack[-1]
        if not kind:
            top.texts.append(name)
            continue
        if kind == "/":
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth].tag != name:
                    depth -= 1
                shut(depth)
            if name not in INLINE:
                stack[-1].texts.append(None)
            continue
        if name in VOID:
            if name not in INLINE:
                top.texts.append(None)
            continue
        if name in INLINE and not top.never and not (attributes and _look(name, attributes, True)[1]):
            continue
        if (ends := CLOSES.get(name)) and top.tag in ends:
            depth = len(stack) - 1
            while depth > 1 and stack[depth - 1].tag in ends:
                depth -= 1
            shut(depth)
        elif name in CLOSE_P and ps and (not barriers or ps[-1] > barriers[-1]):
            shut(ps[-1])
        top = stack[-1]
        within = top.tag in ("article", "main") or top.within
        key, never = _look(name, attributes, within)
        alike = top.children.setdefault(key, [])
        node = Node(name, key, xxhash.xxh64_intdigest(f"{top.path} {len(alike)} {key}"), never or top.never, within)
        alike.append(node)
        top.texts.append(node)
        if name == "p":
            ps.append(len(stack))
        if name in BARRIERS:
            barriers.append(len(stack))
        opened[name] += 1
        stack.append(node)
    return root


def _block(parts: list[str]) -> str:
    whole = "".join(parts)
    return " ".join((html.unescape(whole) if "&" in whole else whole).split())


def walk(root: Node) -> list[Node]:
    """All nodes that aren't out by their kind, parents first."""
    out, stack = [], [root]
    while stack:
        top = stack.pop()
        out.append(top)
        stack.extend(x for x in reversed(top.texts) if isinstance(x, Node) and not x.never)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_nodes(page: str) -> list[tuple[int, int, int, int, int]]:
    """(unit, path, parent, presentation, content) of the page's nodes; the unit tells pages apart: by their article, or else by all their html."""
    root = parse(page)
    nodes = walk(root)
    for node in reversed(nodes):
        seen = xxhash.xxh64()
        for x in node.texts:
            if isinstance(x, str):
                seen.update(" ".join(x.split()).encode("utf-8", "replace"))
            elif x is None or not x.never:
                seen.update(b"\0" if x is None else x.digest.to_bytes(8, "little"))
        node.digest = seen.intdigest()
    whole = xxhash.xxh64_intdigest(page.encode("utf-8", "replace"))
    out, units = [], {id(root): whole}
    parents = {id(root): 0}
    for node in nodes:
        unit = node.digest if node.tag in ("article", "main") and not node.within else units[id(node)]
        kids = [x for x in node.texts if isinstance(x, Node) and not x.never]
        for x in kids:
            units[id(x)], parents[id(x)] = unit, node.path
        if node.path:
            style = xxhash.xxh64_intdigest("\0".join(x.key for x in kids))
            out.append((_signed(unit), _signed(node.path), _signed(parents[id(node)]), _signed(style), _signed(node.digest)))
    return out


def extract(page: str, low: frozenset[int] | set[int]) -> str:
    """The blocks of the page's article, or of all the page if it has none, without low branches, joined by a space."""
    root = parse(page)

    def gone(node: Node) -> bool:
        return node.never or (bool(low) and node.tag not in KEPT and _signed(node.path) in low)

    tops, stack = [], [root]
    while stack:
        top = stack.pop()
        if top.tag == "article" or top.tag == "main" and not any(n.tag == "article" and not gone(n) for n in walk(top)[1:]):
            tops.append(top)
            continue
        stack.extend(x for x in reversed(top.texts) if isinstance(x, Node) and not gone(x))
    blocks: list[str] = []
    for top in tops or [root]:
        parts: list[str] = []
        work: list[Node | str | None] = [None, *reversed(top.texts)]
        while work:
            x = work.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            if parts:
                if block := _block(parts):
                    blocks.append(block)
                parts = []
            if x is not None and not gone(x):
                work.append(None)
                work.extend(reversed(x.texts))
    return " ".join(blocks)


NODES = "host string, unit long, path long, parent long, style long, content long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = dict.fromkeys((host, *x) for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True) for x in page_nodes(page or ""))
        if seen:
            host, *rest = zip(*seen, strict=True)
            names = [x.split()[0] for x in NODES.split(", ")]
            yield pa.RecordBatch.from_pydict({"host": pa.array(host, pa.string())} | {n: pa.array(x, pa.int64()) for n, x in zip(names[1:], rest, strict=True)})


def importances(pages: DataFrame, ws: Workspace) -> DataFrame:
    """host, path, parent and importance of each node of the hosts' style trees. pages: host, html."""
    shown = ws.save(pages.select("host", "html").mapInArrow(_nodes, NODES).distinct(), "shown")
    each = shown.select("host", "path", "parent", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("x"))
    counts = each.groupBy("host", "path", "parent", "x.kind", "x.value").agg(F.count("*").alias("n"))
    style, n = F.col("kind") == 0, F.col("n")
    sums = counts.groupBy("host", "path", "parent").agg(
        F.sum(F.when(style, n)).alias("m"), F.count_if(style).alias("styles"), F.sum(F.when(style, n * F.log(n))).alias("presentation"), F.sum(F.when(~style, n * F.log(n))).alias("content"),
    )
    pages_ = F.col("m") + PRIOR_PAGES
    entropy = lambda x: 1 - F.col(x) / (pages_ * F.log(pages_))
    g = F.pow(F.lit(0.9), F.col("styles"))
    return sums.select("host", "path", "parent", ((1 - g) * entropy("presentation") + g * entropy("content")).alias("importance"))


def low_nodes(pages: DataFrame, threshold: float, ws: Workspace) -> DataFrame:
    """host and path of the nodes below the threshold, without those whose parent is below it."""
    low = ws.save(importances(pages, ws).filter(F.col("importance") < threshold).select("host", "path", "parent"), "low")
    return ws.save(same(low, low.select("host", F.col("path").alias("parent")), ["host", "parent"], "left_anti").select("host", "path"), "topmost")


def main_text(pages: DataFrame, threshold: float = 0.3, url: str = "url", page: str = "html", key: str = "page_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """key, url and text of each row of pages."""
    ws = Workspace(pages.sparkSession, "site-tree")
    host = F.lower(F.regexp_extract(pages[url], r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(pages[key].cast("long").alias("k"), pages[url].alias("u"), host.alias("host"), pages[page].alias("html"))
    low = low_nodes(rows, threshold, ws)

    def texts(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        out = [extract(x or "", y or ()) for x, y in zip(b.column("html").to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_pydict({"k": b.column("k"), "u": b.column("u"), "text": pa.array(out, pa.string())})

    if (low.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 48)).first()[0] or 0) <= max_broadcast:
        known: dict[str | None, set[int]] = {}
        for r in low.collect():
            known.setdefault(r["host"], set()).add(r["path"])
        shared = pages.sparkSession.sparkContext.broadcast(known)
        done = rows.mapInArrow(per_batch(lambda b: texts(b, [shared.value.get(h) for h in b.column("host").to_pylist()])), "k long, u string, text string")
    else:
        listed = rows.withColumn("doc", F.xxhash64("html"))
        hit = same(listed.mapInArrow(per_batch(_paths), "k long, host string, doc long, path long"), low, ["host", "path"], "left_semi")
        own = hit.groupBy("k", "host", "doc").agg(F.collect_set("path").alias("low"))
        both = same(listed, own, ["k", "host", "doc"], "left").select("k", "u", "html", "low")
        done = both.mapInArrow(per_batch(lambda b: texts(b, [set(x or ()) for x in b.column("low").to_pylist()])), "k long, u string, text string")
    return done.select(F.col("k").alias(key), F.col("u").alias(url), "text")


def _paths(b: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each node of each page."""
    at, found = [], []
    for i, page in enumerate(b.column("html").to_pylist()):
        own = {x[1] for x in page_nodes(page or "")}
        at += [i] * len(own)
        found += own
    rows = pa.array(at, pa.int64())
    return pa.RecordBatch.from_pydict({c: b.column(c).take(rows) for c in ("k", "host", "doc")} | {"path": pa.array(found, pa.int64())})


def op7_site_tree(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
