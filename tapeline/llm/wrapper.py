"""Main-text extraction by wrapper induction.

Pages of a host and layout (the labels of the wanted elements of their body) are aligned with
its reference page (the smallest page_id) by simple tree matching. Over all pages that are no
copy of the reference, each reference node counts how often its own text is equal, and how much
text outside links varies at it, text of unaligned nodes counting at their nearest aligned
ancestor. From these counts, summed per layout and node, the wrapper follows:

- region: from the root down as long as one child has REGION of the varying text and no sibling
  has a heading whose text varies, and never into an article element; this is where the content is;
- template: outside the region, nodes whose own text is equal on CONSTANT of the pages that have
  them; inside it, nodes whose text is equal on CONSTANT of at least ARTICLES different articles.

Near copies of one article share paragraphs, which are no template. So a near copy of the
reference counts nothing: a page with equal headings and more equal texts than other ones, or,
where it has no heading, with ALIKE times as many. And inside the region one page counts of near
copies of each other: pages whose differing texts share one of SIGNATURES minimum hashes are near
copies, and the one that is first by all its hashes counts.

A page's text is that of the node aligned with the region, without template nodes. Names decide
only what the wrapper cannot: a page that is alone in its layout, or that lacks the region, takes
its article, main or whole body; and menus, forms, adverts and comments within the region are
left out by element or class name.

Matching is exact while the children that are left after equal ends are paired make at most
MATCH_CELLS pairs in a page; beyond it subtrees that occur once are paired by a longest increasing
subsequence, and what lies between them in order of equal labels. A node that finds no partner
keeps its text, so this can leave a template text in a page but drops none.

Pages are parsed once; what is written between the steps are their trees. The wrappers go with
the tasks while they are below WRAPPERS_BYTES in all; beyond it pages travel to their wrapper,
dealt over many tasks per layout, and a wrapper travels once to each.
"""

from __future__ import annotations

import bisect
import html as entities
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapeline.llm import common

WRAPPERS_BYTES = 16_000_000
#: Share of pages on which a template node's text is equal.
CONSTANT = 0.9
#: Different articles besides the reference that a template node needs inside the region, and minimum hashes that tell near copies.
ARTICLES, SIGNATURES = 5, 8
#: Equal texts for each other one that make a page without headings a near copy of the reference.
ALIKE = 5
#: Share of the varying text that makes a child the region.
REGION = 0.7
#: Nodes and signatures that a task holds before it hands them on.
HELD = 100_000
#: Pairs of children compared exactly for one page.
MATCH_CELLS = 50_000

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_STOP = re.compile("[>\"']")
_RAW = {t: re.compile(f"</{t}(?![\\w:-])", re.I) for t in "script style noscript template textarea iframe svg title select".split()}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_DIGITS = re.compile(r"\d+")
_HEADINGS = frozenset("h1 h2 h3".split())
#: Elements without content, elements that end a block, and elements and names that are never content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_NOT_CONTENT = frozenset("nav header footer aside form button menu dialog head input label".split())
_NOT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies respond share sharing sidebar signup skip-link social sponsor sponsored subscribe toolbar widget".split()
)


class Node:
    """An element. Children and own text are asked for when the tree is whole, and kept."""

    __slots__ = ("tag", "names", "parts", "label", "shape", "size", "kids", "own")

    def __init__(self, tag: str, names: frozenset[str]):
        self.tag, self.names, self.parts = tag, names, []  # parts: texts and nodes, in order
        self.label = f"{tag}.{_DIGITS.sub('#', '.'.join(sorted(names)))}" if names else tag
        self.kids = self.own = None

    def children(self) -> list[Node]:
        if self.kids is None:
            self.kids = [p for p in self.parts if p.__class__ is Node]
        return self.kids

    def text(self) -> str:
        if self.own is None:
            self.own = " ".join(" ".join([p for p in self.parts if p.__class__ is str]).split())
        return self.own


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, open, empty (an open tag that ends in a slash), close; raw elements give one space. Linear in the page."""
    at = held = 0
    last = {q: page.rfind(q) for q in "\"'>"}
    quoted = True
    while (lt := page.find("<", at)) >= 0:
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + (4 if comment else 1))
            end = len(page) if end < 0 else end + (3 if comment else 1)
            if held < lt:
                yield "text", page[held:lt], ""
            at = held = end
            continue
        close = nxt == "/"
        m = _NAME.match(page, lt + 1 + close)
        if m is None or last[">"] < m.end():
            at = lt + 1  # a sign, not a tag
            continue
        end = m.end()
        while quoted and (stop := _STOP.search(page, end)) and (q := stop.group()) != ">":
            end = page.find(q, stop.end()) + 1 if stop.start() < last[q] else stop.end()
        quoted = quoted and stop is not None  # once the quotes of a page do not close, they count for nothing
        end = stop.start() if quoted else page.find(">", m.end())
        if held < lt:
            yield "text", page[held:lt], ""
        name, attributes = m.group().lower(), page[m.end() : end]
        at = held = end + 1
        if not close and name in _RAW:
            m = _RAW[name].search(page, at)
            at = page.find(">", m.end()) + 1 if m else 0
            at = held = at or len(page)
            yield "text", " ", ""
        else:
            yield ("close" if close else "empty" if attributes.rstrip().endswith("/") else "open"), name, attributes
    if held < len(page):
        yield "text", page[held:], ""


_CLOSES = {"li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}


def parse(page: str) -> Node:
    """A forgiving tree: paragraphs and list items end where the next begins, stray end tags are ignored."""
    root = Node("#", frozenset())
    stack = [root]
    opened: Counter = Counter()

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            stack[-1].parts.append(entities.unescape(tag) if "&" in tag else tag)
            continue
        if kind == "close":
            if opened[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                cut(k)
            continue
        if tag in _BLOCK and tag not in ("html", "body"):
            closes = _CLOSES.get(tag, {"p"})
            if any(opened[t] for t in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closes:
                        cut(k)
                        break
                    if stack[k].tag in _BLOCK:
                        break
        names = {w.lower() for _, a, b, c in _ATTRIBUTE.findall(attributes) for w in (a or b or c).split()} if attributes else ()
        node = Node(tag, frozenset(names))
        stack[-1].parts.append(node)
        if tag not in _VOID and kind == "open":
            stack.append(node)
            opened[tag] += 1
    return root


def dump(root: Node) -> bytes:
    """A tree as bytes: tags with names, texts, and None where an element ends."""
    flat: list = []
    todo: list = [p for p in reversed(root.parts)]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            flat.append((x.tag, *sorted(x.names)))
            todo.append(None)
            todo += reversed(x.parts)
        else:
            flat.append(x)
    return pickle.dumps(flat, 5)


_NO_NAMES: frozenset[str] = frozenset()


def load(tree: bytes) -> Node:
    """The tree of `dump`."""
    root = Node("#", _NO_NAMES)
    stack = [root]
    for x in pickle.loads(tree):
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            stack[-1].parts.append(x)
        else:
            node = Node(x[0], frozenset(x[1:]) if len(x) > 1 else _NO_NAMES)
            stack[-1].parts.append(node)
            stack.append(node)
    return root


def numbered(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children())
    return out


def shaped(root: Node) -> None:
    """Give every node a hash of its subtree's labels, and its size."""
    for n in reversed(numbered(root)):
        below = n.children()
        n.size = 1 + sum([c.size for c in below])
        n.shape = hash((n.label, *[c.shape for c in below])) if below else hash(n.label)


def _in_order(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of many children: subtrees that occur once on each side by a longest increasing subsequence, and equal labels in order between them."""
    once_x, once_y = ({h for h, n in Counter(c.shape for c in side).items() if n == 1} for side in (xs, ys))
    places = {v.shape: j for j, v in enumerate(ys) if v.shape in once_y}
    tails: list[int] = []
    ends: list[tuple] = []
    for i, u in enumerate(xs):
        if u.shape in once_x and u.shape in places:
            j = places[u.shape]
            k = bisect.bisect_left(tails, j)
            link = (i, j, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            else:
                tails[k], ends[k] = j, link
    anchors, link = [], ends[-1] if ends else None
    while link:
        anchors.append(link[:2])
        link = link[2]
    out, i, j = [], 0, 0
    for a, b in [*reversed(anchors), (len(xs), len(ys))]:
        while i < a and j < b:
            ahead = next((k for k in range(j, min(b, j + 8)) if ys[k].label == xs[i].label), None)
            if ahead is not None:
                out.append((xs[i], ys[ahead]))
                j = ahead + 1
            i += 1
        if a < len(xs):
            out.append((xs[a], ys[b]))
        i, j = a + 1, b + 1
    return out


def _best(xs: list[Node], ys: list[Node], weight: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """The order-keeping pairs of equal labels with the largest sum of weights."""
    table = [[0] * (len(ys) + 1)]
    for u in xs:
        above, row = table[-1], [0]
        for j, v in enumerate(ys):
            best = row[j] if row[j] > above[j + 1] else above[j + 1]
            if u.label == v.label and (w := above[j] + weight[id(u), id(v)]) > best:
                best = w
            row.append(best)
        table.append(row)
    i, j, out = len(xs), len(ys), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out[::-1]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest order-keeping match of nodes with equal labels under matched parents.

    Equal subtrees at both ends of two child lists are paired first, which loses nothing: each
    then has its largest possible weight. No recursion, so depth does not matter.
    """
    for root in (a, b):
        if not hasattr(root, "shape"):  # a reference meets many pages
            shaped(root)
    pairs: dict[tuple[int, int], list] = {}
    weight: dict[tuple[int, int], int] = {}
    left = [MATCH_CELLS]

    def split(x: Node, y: Node) -> tuple[list, list[Node], list[Node]]:
        xs, ys = x.children(), y.children()
        n = min(len(xs), len(ys))
        p = 0
        while p < n and xs[p].shape == ys[p].shape:
            p += 1
        q = 0
        while q < n - p and xs[-1 - q].shape == ys[-1 - q].shape:
            q += 1
        ends = list(zip(xs[:p], ys[:p])) + list(zip(xs[len(xs) - q :], ys[len(ys) - q :]))
        return ends, xs[p : len(xs) - q], ys[p : len(ys) - q]

    todo: list[tuple[Node, Node, tuple | None, list | None]] = [(a, b, None, None)]
    while todo:
        x, y, parts, rough = todo.pop()
        if (id(x), id(y)) in weight:
            continue
        if x.shape == y.shape:
            weight[id(x), id(y)] = x.size
            continue
        if parts is None:
            parts = split(x, y)
            _, xs, ys = parts
            if len(xs) * len(ys) > left[0]:
                rough = _in_order(xs, ys)
                below = rough
            else:
                left[0] -= len(xs) * len(ys)
                below = [(u, v) for u in xs for v in ys if u.label == v.label]
            todo.append((x, y, parts, rough))
            todo += [(u, v, None, None) for u, v in below if (id(u), id(v)) not in weight]
            continue
        ends, xs, ys = parts
        middle = rough if rough is not None else _best(xs, ys, weight)
        pairs[id(x), id(y)] = ends + middle
        weight[id(x), id(y)] = 1 + sum(u.size for u, _ in ends) + sum(weight[id(u), id(v)] for u, v in middle)
    out, todo = [(a, b)], [(a, b)]
    while todo:
        x, y = todo.pop()
        found = pairs.get((id(x), id(y)))
        found = list(zip(x.children(), y.children())) if found is None else found
        out += found
        todo += found
    return out


def _unwanted(node: Node) -> bool:
    return node.tag in _NOT_CONTENT or bool(node.names & _NOT_NAMES)


def _mains(root: Node) -> list[Node]:
    """The outermost wanted articles of a page, else its outermost main elements."""
    nodes = numbered(root)
    banned: set[int] = set()
    for n in nodes:
        if id(n) in banned or _unwanted(n):
            banned |= {id(c) for c in n.children()}
    mains = [n for n in nodes if n.tag == "article" and not _unwanted(n) and id(n) not in banned] or [n for n in nodes if (n.tag == "main" or "main" in n.names) and id(n) not in banned]
    nested: set[int] = set()
    for n in mains:
        if id(n) not in nested:
            nested |= {id(d) for d in numbered(n)[1:]}
    return [n for n in mains if id(n) not in nested]


def layout(root: Node) -> str:
    """What pages of one layout share: the labels of the wanted elements of the body."""
    body = next((n for n in numbered(root) if n.tag == "body"), root)
    return " ".join(sorted({n.label for n in body.children() if not _unwanted(n)}))


def _content(tops: list[Node], template: set[int], inside: bool) -> str:
    """The text of the tops without template nodes' own texts and what is left out by name; inside: headers are content."""
    blocks: list[list[str]] = [[]]
    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                blocks[-1].append(x)
                continue
            if x is None:
                blocks.append([])
                continue
            if x is not top and (x.names & _NOT_NAMES or x.tag in _NOT_CONTENT and not (inside and x.tag in ("header", "label"))):
                blocks.append([])
                continue
            if x.tag in _BLOCK:
                blocks.append([])
                todo.append(None)
            elif x.tag == "br":
                blocks[-1].append(" ")
            todo += [p for p in reversed(x.parts) if not (isinstance(p, str) and id(x) in template)]
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


@lru_cache(maxsize=32)
def _reference(tree: bytes) -> tuple[Node, dict[int, int]]:
    """A reference page's tree, and the number of each of its nodes."""
    ref = load(tree)
    return ref, {id(n): k for k, n in enumerate(numbered(ref))}


def _whole(node: Node) -> str:
    return " ".join(" ".join(p for n in numbered(node) for p in n.parts if isinstance(p, str)).split())


def near_copy(root: Node, home: dict[int, Node]) -> bool:
    """Whether a page is a near copy of the reference, by the partner of each of its nodes."""
    same = other = 0
    headings: list[bool] = []
    todo = [root]
    while todo:
        y = todo.pop()
        if y.tag in ("a", "head", "option", "button"):
            continue
        x, own = home.get(id(y)), y.text()
        if own:
            equal = x is not None and x.text() == own
            same, other = same + equal, other + (not equal)
        if y.tag in _HEADINGS and (whole := _whole(y)):
            headings.append(x is not None and _whole(x) == whole)
        todo += y.children()
    return all(headings) and same > other * (1 if headings else ALIKE - 1)


def varying(reference: bytes, root: Node) -> dict[int, list[int]] | None:
    """For each node of the reference, by its number, that the page has: pages with an own text (0 or 1), of these equal ones, and letters outside links that vary; None for a near copy."""
    ref, number = _reference(reference)
    home = {id(y): x for x, y in align(ref, root)}
    if near_copy(root, home):
        return None
    out: dict[int, list[int]] = {}
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        y, at, link = todo.pop()
        link = link or y.tag == "a" or y.tag in ("head", "option", "button")
        x = home.get(id(y))
        own = y.text()
        if x is None:
            out[at][2] += 0 if link else len(own)
        else:
            at = number[id(x)]
            there = x.text()
            out[at] = [int(bool(there)), int(bool(there) and there == own), 0 if link or there == own else len(own)]
        todo += [(c, at, link) for c in y.children()]
    return out


def wrapper_of(reference: bytes, counts: dict[int, tuple[int, int, int]], pages: int) -> tuple[int | None, list[int], list[int]]:
    """Region, template nodes outside it, and nodes inside it that may be template, from the sums of `varying` over a layout's pages."""
    ref = load(reference)
    nodes, articles = numbered(ref), {id(n) for n in _mains(ref) if n.tag == "article"}
    number = {id(n): k for k, n in enumerate(nodes)}
    below = [0] * len(nodes)
    headed = [False] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        own = counts.get(k, (0, 0, 0))[2]
        kids = [number[id(c)] for c in n.children()]
        below[k] = own + sum(below[c] for c in kids)
        headed[k] = n.tag in _HEADINGS and below[k] > 0 or any(headed[c] for c in kids)
    at = 0 if pages and below and below[0] else None
    while at is not None and id(nodes[at]) not in articles:
        kids = [number[id(c)] for c in nodes[at].children()]
        top = max(kids, key=lambda c: below[c], default=None)
        if top is None or below[top] < REGION * below[at] or any(headed[c] for c in kids if c != top):
            break
        at = top
    inside = {number[id(n)] for n in numbered(nodes[at])} if at is not None and nodes[at].tag not in ("#", "html", "body") else set()
    template = [k for k, (n, equal, _) in sorted(counts.items()) if k not in inside and n and equal >= CONSTANT * n]
    return at, template, [k for k, (_, equal, _) in sorted(counts.items()) if k in inside and equal >= ARTICLES]


_ODD = np.random.default_rng(20250301).integers(1, 2**63, SIGNATURES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def article(reference: bytes, root: Node, region: int, candidates: list[int]) -> tuple[list[int], list[tuple[int, bool]]] | None:
    """Minimum hashes of a page's texts in the region that differ from the reference, and which candidates have its text; None for a near copy of the reference, or without the region."""
    ref, number = _reference(reference)
    pairs = align(ref, root)
    top = next((y for x, y in pairs if number[id(x)] == region), None)
    if top is None:
        return None
    home = {id(y): x for x, y in pairs}
    if near_copy(root, home):
        return None
    hashes: list[int] = []
    flags: dict[int, bool] = {}
    for y in numbered(top):
        x, own = home.get(id(y)), y.text()
        there = x.text() if x is not None else ""
        if there:
            flags[number[id(x)]] = there == own
        if own and own != there:
            hashes.append(xxhash.xxh3_64_intdigest(own))
    if not hashes:
        return None
    mixed = np.array(hashes, np.uint64)[:, None] * _ODD
    return (mixed ^ (mixed >> np.uint64(29))).min(axis=0).view(np.int64).tolist(), [(k, flags[k]) for k in candidates if k in flags]


def extract(page: str | Node | None, reference: bytes | None = None, region: int | None = None, template: list[int] = ()) -> str:
    """The main text of a page (html or its tree), by its layout's wrapper: a reference page, and the numbers of its region and template nodes."""
    if not page:
        return ""
    root = parse(page) if isinstance(page, str) else page
    if reference and (region is not None or template):
        ref, place = _reference(reference)
        pairs, chosen = align(ref, root), set(template)
        constant = {id(y) for x, y in pairs if place[id(x)] in chosen and x.text() == y.text()}
        top = next((y for x, y in pairs if place[id(x)] == region), None)
        if top is not None and (text := _content([top], constant, top.tag not in ("#", "html", "body"))):
            return text
        tops = _mains(root)
        if text := _content(tops or [root], constant if not tops else set(), bool(tops)):
            return text
    tops = _mains(root)
    return _content(tops, set(), True) or _content([root], set(), False)


def _host():
    """The host of a url; a page without one is a host of its own."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]*:?//([^/?#:]+)", 1))
    return F.when(F.coalesce(host, F.lit("")) == "", F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce("html", F.lit(""))))).otherwise(host)


def _laid_out(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, layout, tree) of pages (page_id, url, html); null and empty html have no layout and no tree."""
    kind = dict(pages.dtypes)["page_id"]
    pages = pages.withColumn("host", _host())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html"):
            roots = [parse(h) if h else None for h in batch.column("html").to_pylist()]
            layouts = pa.array([None if r is None else layout(r) for r in roots], pa.string())
            trees = pa.array([None if r is None else dump(r) for r in roots], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), layouts, trees], names=["page_id", "url", "host", "layout", "tree"])

    return common.materialize(pages.mapInArrow(run, f"page_id {kind}, url string, host string, layout string, tree binary"))


def _met(pages: DataFrame, wrappers: DataFrame, run, schema: str) -> DataFrame:
    """Run over pages (.., host, layout, tree) beside the wrapper (bytes) of their host and layout: run(iterator of (wrapper or None, rows))."""
    columns = pages.columns
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if size <= WRAPPERS_BYTES:
        held = {(r.host, r.layout): bytes(r.wrapper) for r in wrappers.select("host", "layout", "wrapper").collect()}
        sent = pages.sparkSession.sparkContext.broadcast(held)  # bounded by WRAPPERS_BYTES

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, "tree"):
                yield from run((sent.value.get((r["host"], r["layout"])), r) for r in batch.to_pylist())

        return pages.mapInArrow(here, schema)
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64("tree", "page_id"), F.lit(common.SALTS)).cast("int"))
    used = salted.select("host", "layout", "_salt").distinct()
    first = wrappers.select("host", "layout", "wrapper").join(used, ["host", "layout"]).select(*[F.lit(None).cast(t).alias(c) if c not in ("host", "layout") else F.col(c) for c, t in pages.dtypes], "_salt", "wrapper")
    met = salted.withColumn("wrapper", F.lit(None).cast("binary")).unionByName(first)
    met = met.repartition("host", "layout", "_salt").sortWithinPartitions("host", "layout", "_salt", F.col("wrapper").desc_nulls_last())

    def travelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = (None, None, None)
        for batch in common.slices(batches, "tree"):
            rows = []
            for r in batch.to_pylist():
                if r["wrapper"] is not None:
                    now = (r["host"], r["layout"], r["wrapper"])
                else:
                    rows.append((now[2] if now[:2] == (r["host"], r["layout"]) else None, {c: r[c] for c in columns}))
            yield from run(iter(rows))

    return met.mapInArrow(travelled, schema)


def induce(pages: DataFrame) -> DataFrame:
    """pages (page_id, host, layout, tree) to one wrapper per host and layout: (host, layout, wrapper), the wrapper as bytes of reference, region and template."""
    by = ["host", "layout"]
    some = pages.where("tree is not null").select("page_id", *by, "tree")
    refs = common.materialize(some.groupBy(*by).agg(F.min(F.struct("page_id", "tree")).alias("r")).select(*by, F.col("r.tree").alias("wrapper")))

    def count(rows: Iterator[tuple[bytes | None, dict]]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, int], list[int]] = defaultdict(lambda: [0, 0, 0])

        def flush() -> pa.RecordBatch:
            cols = [*([k[c] for k in seen] for c in range(3)), *([n[c] for n in seen.values()] for c in range(3))]
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["host", "layout", "node", "n", "equal", "letters"])

        for reference, r in rows:
            if reference is None or r["tree"] == reference:
                continue
            found_at = varying(reference, load(r["tree"]))
            if found_at is None:
                continue
            seen[r["host"], r["layout"], -1][0] += 1
            for node, found in found_at.items():
                n = seen[r["host"], r["layout"], node]
                for k in range(3):
                    n[k] += found[k]
            if len(seen) >= HELD:
                yield flush()
                seen.clear()
        yield flush()

    counts = _met(some, refs, count, "host string, layout string, node int, n long, equal long, letters long")
    sums = counts.groupBy(*by, "node").agg(*(F.sum(c).alias(c) for c in ("n", "equal", "letters")))
    listed = sums.groupBy(*by).agg(F.collect_list(F.struct("node", "n", "equal", "letters")).alias("counts"))  # bounded by the nodes of a page

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "wrapper"):
            out, open_ = [], []
            for reference, found in zip(batch.column("wrapper").to_pylist(), batch.column("counts").to_pylist()):
                by_node = {c["node"]: (c["n"], c["equal"], c["letters"]) for c in found or ()}
                n = by_node.pop(-1, (0, 0, 0))[0]
                region, template, candidates = wrapper_of(reference, by_node, n)
                out.append(pickle.dumps((reference, region, template, candidates), 5))
                open_.append(bool(candidates))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(out, pa.binary()), pa.array(open_, pa.bool_())], names=["host", "layout", "wrapper", "open"])

    first = common.materialize(refs.join(listed, by, "left").mapInArrow(settle, "host string, layout string, wrapper binary, open boolean"))
    undecided = first.where("open")
    if undecided.isEmpty():
        return first.drop("open")

    def judge(rows: Iterator[tuple[bytes | None, dict]]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["host", "layout", "page", "k", "hash", "nodes", "equal"], (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        out: list[tuple] = []
        settled = _Settled()
        for wrapper, r in rows:
            if wrapper is None:
                continue
            reference, region, _, candidates = settled[wrapper]
            found = article(reference, load(r["tree"]), region, candidates) if r["tree"] != reference else None
            if found:
                page = xxhash.xxh3_64_intdigest(r["tree"]) - (1 << 63)
                out += [(r["host"], r["layout"], page, k, h, [n for n, _ in found[1]], [e for _, e in found[1]]) for k, h in enumerate(found[0])]
            if len(out) >= HELD // 10:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    of_open = some.join(F.broadcast(undecided.select(*by)) if undecided.count() <= HELD else undecided.select(*by), by, "left_semi")
    signs = _met(of_open, undecided, judge, "host string, layout string, page long, k int, hash long, nodes array<int>, equal array<boolean>")
    # a page counts if it is the first of every hash it has: near copies of it have one of these hashes and are not
    firsts = signs.groupBy(*by, "k", "hash").agg(F.min(F.struct("page", "nodes", "equal")).alias("p")).select(*by, "p.*")
    counted = firsts.groupBy(*by, "page").agg(F.count("*").alias("n"), F.first("nodes").alias("nodes"), F.first("equal").alias("equal")).where(F.col("n") == SIGNATURES)
    flags = counted.select(*by, F.explode(F.arrays_zip("nodes", "equal")).alias("f"))
    per_node = flags.groupBy(*by, F.col("f.nodes").alias("node")).agg(F.count("*").alias("n"), F.count_if("f.equal").alias("equal")).where((F.col("n") >= ARTICLES) & (F.col("equal") >= CONSTANT * F.col("n")))
    chosen = per_node.groupBy(*by).agg(F.collect_list("node").alias("more"))  # bounded by the nodes of a page

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wrapper, more in zip(batch.column("wrapper").to_pylist(), batch.column("more").to_pylist()):
                reference, region, template, _ = pickle.loads(wrapper)
                out.append(pickle.dumps((reference, region, sorted({*template, *(more or ())}), []), 5))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(out, pa.binary())], names=["host", "layout", "wrapper"])

    return common.materialize(first.join(chosen, by, "left").select(*by, "wrapper", "more").mapInArrow(complete, "host string, layout string, wrapper binary"))


class _Settled(dict):
    """Wrappers that a task has read, a hundred at a time."""

    def __missing__(self, wrapper: bytes) -> tuple:
        if len(self) >= 100:
            self.clear()
        self[wrapper] = found = pickle.loads(wrapper)
        return found


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages: (page_id, url, text, n_chars). Null html counts as empty, and a page without a host in its url is alone.

    Rows with equal ids stay apart, copies of a reference count nothing towards its wrapper, an
    empty table gives an empty result, and other columns are ignored. Pages of any depth and
    length are read whole, unclosed tags and quotes included.
    """
    common.small_batches(pages.sparkSession)
    pages = _laid_out(pages.select("page_id", "url", "html"))
    wrappers = induce(pages)
    kind = pages.schema["page_id"].dataType

    def run(rows: Iterator[tuple[bytes | None, dict]]) -> Iterator[pa.RecordBatch]:
        settled, out = _Settled(), []
        for wrapper, r in rows:
            out.append((r["page_id"], r["url"], "" if r["tree"] is None else extract(load(r["tree"]), *(settled[wrapper][:3] if wrapper else ()))))
        ids, urls, texts = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return _met(pages, wrappers, run, f"page_id {kind.simpleString()}, url string, text string, n_chars long")
