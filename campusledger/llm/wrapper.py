"""HTML main-text extraction by wrapper induction.

Pages of one host come from one wrapper. One page of each host is its seed;
every page's tree is aligned with the seed's by simple tree matching (Yang
1991: the order-preserving matching of children with the most matched nodes,
by dynamic programming at each level). A block of text thereby gets a slot, the
seed block it is matched to; a block matched to nothing (a second layout on the
host) gets the path of its element names, classes and ids instead. Counted over all
pages of the host, a slot whose text stays the same is template and goes; slots that
vary may be content.

Varying slots also hold rotating adverts, menus and notices. Those are told by
their markup: elements that never are article text (navigation, footers, forms,
scripts...) and elements whose class, id or role names such a part. If a page
marks its article (``article``, ``main``), text outside it is not content.

How often a text stands in a slot is counted in distinct articles (pages with
different longest blocks), so that copies of one article on a host do not turn
its paragraphs into template. All pages are counted; the counts are aggregated
in Spark by (host, slot, text hash).

Steps: choose seeds (a hash aggregate and a join on host), align (Python, one
page and its host's seed at a time), store the blocks, count, and join the
template of each host back. A host with a third of all pages meets partial
aggregates, and joins that are broadcast where the host table is small and
split by AQE where it is not.

Cases: null or empty html gives the empty text. A page without a host (null or
odd url) or alone on its host has varying slots only. Broken markup is read
tolerantly: a block start closes an open paragraph. Repeated rows each get a
row; extra columns are ignored. Nothing is cut off or capped.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import each_batch, record_batch, small_batches, stored

MIN_ARTICLES = 3            # distinct articles that must share a slot's text
MIN_SHARE = 0.5             # and their share among the host's articles with that slot
_CELLS = 1 << 20            # cells of the matching table held at once
_KEPT_SHAPES = 5_000        # shapes a host's matcher remembers
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside "
                     "form button select option textarea input dialog menu".split())
ARTICLE = frozenset({"article", "main"})
CLOSED_BY_BLOCK = "p"
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                  "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table".split())

# Names of parts that are not article text, as they stand in class, id or role.
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr menu nav navbar navigation breadcrumb breadcrumbs sidebar side-bar aside footer site-footer site-header "
    "masthead header topbar toolbar share sharing social comment comments disqus reply replies related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay notice notices alert widget "
    "widgets pagination pager skip-link search contentinfo complementary".split())


_CUT_TAG = re.compile(r"<[/!A-Za-z][^<>]*\Z")     # a tag that the end of the page cuts off


class Node:
    """An element that holds blocks, or a block of text (``text`` set, no children)."""

    __slots__ = ("label", "children", "text", "inside", "skipped", "number", "shape", "path")

    def __init__(self, label: str, text: str | None = None, inside: bool = False, skipped: bool = False):
        self.label, self.text, self.inside, self.skipped = label, text, inside, skipped
        self.children: list[Node] = []
        self.number = self.shape = self.path = -1


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open: list[tuple[str, Node]] = [("#root", self.root)]
        self.names: Counter = Counter()                 # open elements by name
        self.words: list[str] = []

    def _end_block(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            self.words = []
            if text:
                top = self.open[-1][1]
                top.children.append(Node("#text", text, top.inside, top.skipped))

    def _close(self, at: int) -> None:
        self._end_block()
        self.names.subtract(name for name, _ in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "br" or tag == "img":
                self.words.append(" ")
            return
        ends = (CLOSED_BY_BLOCK, *CLOSED_BY_SAME.get(tag, ()))
        for at in range(len(self.open) - 1 if any(self.names[n] > 0 for n in ends) else 0, 0, -1):     # implied end tags
            name = self.open[at][0]
            if name == CLOSED_BY_BLOCK or name in CLOSED_BY_SAME.get(tag, ()):
                self._close(at)
                break
            if name in LISTS and tag in CLOSED_BY_SAME:
                break
        self._end_block()
        top = self.open[-1][1]
        names = set()
        for key, value in attrs:
            if value and key in ("class", "id", "role"):
                names.update(value.lower().replace("_", "-").split())
        inside = top.inside or tag in ARTICLE
        # a header inside an article is its headline
        skipped = (top.skipped or tag in NOT_TEXT or (tag == "header" and not top.inside)
                   or (tag not in ARTICLE and tag != "body" and bool(names & PART_NAMES)))
        node = Node(" ".join([tag, *sorted(names)]) if names else tag, None, inside, skipped)
        top.children.append(node)
        if tag not in VOID:
            self.open.append((tag, node))
            self.names[tag] += 1

    def handle_endtag(self, tag):
        if tag in INLINE or tag in VOID:
            return
        if self.names[tag] > 0:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] == tag:
                    self._close(at)
                    return
        self._end_block()

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.words.append(data)


def parse(html: str) -> tuple[Node, list[Node]]:
    """The block tree of a page and its text blocks in page order, numbered."""
    builder = _Builder()
    builder.feed(_CUT_TAG.sub("", html))
    builder.close()
    builder._end_block()
    blocks: list[Node] = []
    stack = [builder.root]
    while stack:
        n = stack.pop()
        if n.text is not None:
            n.number = len(blocks)
            blocks.append(n)
        for c in n.children:
            c.path = zlib.crc32(c.label.encode("utf-8", "surrogatepass"), max(n.path, 0))
        stack.extend(reversed(n.children))
    return builder.root, blocks


class Matcher:
    """Simple tree matching with one memo for all pages of a seed.

    Trees of equal shape (labels and order) match alike, so weights are kept by
    shape. Equal shapes at the start and at the end of two lists of children belong
    together in some best matching (neither can gain more elsewhere); only what
    differs between them is aligned by the quadratic recurrence, row by row in numpy.
    Nothing recurses: pages may be nested as deep as they like.
    """

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.kinds: list[tuple] = []                    # shape -> (label, shapes of the children)
        self.sizes: list[int] = []                      # shape -> nodes
        self.weights: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        """Give every node of a tree the number of its shape."""
        order, stack = [], [root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack.extend(n.children)
        for n in reversed(order):
            kind = (n.label, *(c.shape for c in n.children))
            if kind not in self.shapes:
                self.shapes[kind] = len(self.kinds)
                self.kinds.append((n.label, kind[1:]))
                self.sizes.append(1 + sum(self.sizes[c] for c in kind[1:]))
            n.shape = self.shapes[kind]

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        (x, xs), (y, ys) = self.kinds[a], self.kinds[b]
        if x != y:
            return 0
        if not xs or not ys:
            return 1
        return self.weights.get((a, b))

    @staticmethod
    def _middle(xs: tuple, ys: tuple) -> tuple[int, int]:
        """How many children are equal at the start, and at the end after those."""
        n = min(len(xs), len(ys))
        head = 0
        while head < n and xs[head] == ys[head]:
            head += 1
        tail = 0
        while tail < n - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        return head, tail

    def _cells(self, xs: tuple, ys: tuple) -> np.ndarray:
        """Weights of all pairs of two lists of shapes, through their distinct shapes."""
        dx, ix = np.unique(np.array(xs), return_inverse=True)
        dy, iy = np.unique(np.array(ys), return_inverse=True)
        table = np.array([[self.weight(int(p), int(q)) for q in dy] for p in dx], np.int32)
        return table[ix][:, iy]

    @staticmethod
    def _table(w: np.ndarray) -> np.ndarray:
        best = np.zeros((w.shape[0] + 1, w.shape[1] + 1), np.int32)
        for i, row in enumerate(w):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + row), out=best[i + 1, 1:])
        return best

    def _last_row(self, xs: tuple, ys: tuple) -> np.ndarray:
        """The last row of the table of two lists, a part of the rows at a time."""
        row = np.zeros(len(ys) + 1, np.int32)
        step = max(1, _CELLS // max(1, len(ys)))
        for at in range(0, len(xs), step):
            for w in self._cells(xs[at:at + step], ys):
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
        return row

    def weight(self, a: int, b: int) -> int:
        """Nodes of a best matching of two shapes."""
        stack = [(a, b)]
        while stack:
            p, q = stack[-1]
            if self._known(p, q) is not None:
                stack.pop()
                continue
            xs, ys = self.kinds[p][1], self.kinds[q][1]
            head, tail = self._middle(xs, ys)
            inner_x, inner_y = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
            wanted = [(c, d) for c in set(inner_x) for d in set(inner_y) if self._known(c, d) is None]
            if wanted:
                stack.extend(wanted)
                continue
            same = sum(self.sizes[c] for c in xs[:head]) + sum(self.sizes[c] for c in xs[len(xs) - tail:])
            inner = int(self._last_row(inner_x, inner_y)[-1]) if inner_x and inner_y else 0
            self.weights[p, q] = 1 + same + inner
            stack.pop()
        return self._known(a, b)

    def _pairs(self, xs: tuple, ys: tuple) -> list[tuple[int, int]]:
        """Places that a best matching of two lists of shapes puts together."""
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            x0, x1, y0, y1 = todo.pop()
            if x0 == x1 or y0 == y1:
                continue
            part_x, part_y = xs[x0:x1], ys[y0:y1]
            if len(part_x) > 1 and len(part_x) * len(part_y) > _CELLS:      # halve: linear memory
                half = len(part_x) // 2
                front = self._last_row(part_x[:half], part_y)
                back = self._last_row(part_x[half:][::-1], part_y[::-1])[::-1]
                cut = int((front + back).argmax())
                todo += [(x0, x0 + half, y0, y0 + cut), (x0 + half, x1, y0 + cut, y1)]
                continue
            w = self._cells(part_x, part_y)
            best, i, j = self._table(w), len(part_x), len(part_y)
            while i and j:
                if w[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + w[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                    out.append((x0 + i, y0 + j))
                elif best[i, j] == best[i - 1, j]:
                    i -= 1
                else:
                    j -= 1
        return out

    def align(self, page: Node, seed: Node) -> dict[int, int]:
        """Page block number -> seed block number; both trees are numbered."""
        matched: dict[int, int] = {}
        todo = [(page, seed)]
        while todo:
            a, b = todo.pop()
            if a.text is not None:
                matched[a.number] = b.number
                continue
            if not a.children or not b.children or not self.weight(a.shape, b.shape):
                continue
            xs, ys = self.kinds[a.shape][1], self.kinds[b.shape][1]
            head, tail = self._middle(xs, ys)
            places = [(i, i) for i in range(head)] + [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]
            inner_x, inner_y = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
            for c in set(inner_x):
                for d in set(inner_y):
                    self.weight(c, d)
            places += [(head + i, head + j) for i, j in self._pairs(inner_x, inner_y)]
            todo.extend((a.children[i], b.children[j]) for i, j in places)
        return matched


def align(page: Node, seed: Node) -> dict[int, int]:
    """Page block number -> seed block number, by simple tree matching."""
    m = Matcher()
    m.number(page)
    m.number(seed)
    return m.align(page, seed)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little",
                          signed=True)


_BLOCK = pa.struct([("text", pa.string()), ("slot", pa.int32()), ("hash", pa.int64()), ("inside", pa.bool_()),
                    ("skipped", pa.bool_())])
_ALIGNED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("article", pa.int64()),
                      ("blocks", pa.list_(_BLOCK))])
_ALIGNED_SQL = ("page_id long, url string, host string, article long, "
                "blocks array<struct<text: string, slot: int, hash: long, inside: boolean, skipped: boolean>>")


def _align_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds: dict[str, tuple[Node, Matcher]] = {}
    for b in each_batch(batches):
        articles, blocks = [], []
        for host, html, seed_html in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            tree, found = parse(html or "")
            slots: dict[int, int] = {}
            if seed_html is not None:
                if host not in seeds or len(seeds[host][1].kinds) > _KEPT_SHAPES:
                    if len(seeds) >= 256:
                        seeds.clear()
                    seeds[host] = parse(seed_html)[0], Matcher()
                    seeds[host][1].number(seeds[host][0])
                seed, matcher = seeds[host]
                matcher.number(tree)
                slots = matcher.align(tree, seed)
            # a block that matches nothing is counted by its path: slots below 0
            blocks.append([{"text": n.text, "slot": slots.get(n.number, -1 - (n.path >> 1)), "hash": _hash(n.text),
                            "inside": n.inside, "skipped": n.skipped} for n in found])
            longest = max((n for n in found if not n.skipped), key=lambda n: len(n.text), default=None)
            articles.append(_hash(longest.text) if longest else 0)
        yield record_batch(_ALIGNED, [b.column(0), b.column(1), b.column(2), articles, blocks])


def host_seeds(pages: DataFrame) -> DataFrame:
    """host, seed: one page of each host, the first by a hash of its markup."""
    known = pages.where("host IS NOT NULL AND length(html) > 0").withColumn("h", F.xxhash64("html"))
    first = known.groupBy("host").agg(F.min("h").alias("h"))
    return known.join(first, ["host", "h"]).select("host", F.col("html").alias("seed")).dropDuplicates(["host"])


def extract(pages: DataFrame, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars, one row each."""
    small_batches(pages.sparkSession, 128)
    host = F.lower(F.regexp_extract("url", HOST, 1))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"),
                         F.when(host != "", host).alias("host"), "html")
    seeds = stored(host_seeds(pages), "seeds")
    aligned = stored(pages.join(seeds, "host", "left").select("page_id", "url", "host", "html", "seed")
                     .mapInArrow(_align_pages, _ALIGNED_SQL), "aligned")

    slots = (aligned.where("host IS NOT NULL").select("host", "article", F.explode("blocks").alias("b"))
             .select("host", "b.slot", "b.hash", "article"))
    uses = slots.groupBy("host", "slot", "hash").agg(F.countDistinct("article").alias("articles"))
    uses = uses.where(F.col("articles") >= min_articles)
    total = slots.groupBy("host", "slot").agg(F.countDistinct("article").alias("total"))
    constant = (uses.join(total, ["host", "slot"]).where(F.col("articles") >= min_share * F.col("total"))
                .groupBy("host").agg(F.collect_list(F.xxhash64("slot", "hash")).alias("template")))
    # at most one entry for each block of the seed and 1 / min_share texts
    template = stored(constant, "template")

    page = aligned.join(template, "host", "left")
    fixed = F.coalesce("template", F.array().cast("array<long>"))
    varying = F.filter("blocks", lambda b: ~b["skipped"] & ~F.array_contains(fixed, F.xxhash64(b["slot"], b["hash"])))
    page = page.select("page_id", "url", F.explode(F.array(varying)).alias("blocks"))
    marked = F.exists("blocks", lambda b: b["inside"])
    content = F.filter("blocks", lambda b: b["inside"] | ~marked)
    text = F.concat_ws("\n\n", F.transform(content, lambda b: b["text"]))
    page = page.select("page_id", "url", text.alias("text"))
    return page.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
