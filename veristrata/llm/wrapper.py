"""Operator 3: main text of web pages by wrapper induction.

Pages of one host share a generator, so their DOM trees align. Each page becomes a skeleton tree in
which runs of equal siblings are one repeated node. Equal skeletons of a host add up; the different ones
are folded, in the order of their digests, into the host's wrapper: simple tree matching (:func:`match`)
aligns two trees, aligned nodes add up, the other nodes are added. Folding runs in two levels (``CHUNKS``
parts of a host by digest, then the parts), so no task folds a host with a third of all pages and reruns
and other partitionings give the same wrapper. In the end nodes on fewer than ``RARE`` of the host's
pages leave it, which bounds it by some pages' size.

Beside the wrapper, the texts of a host's blocks are counted over its distinct pages; pages with the same
longest block are copies or near copies of one article and count as one. An aligned node is template if
its own text, in a block of its own tag and class, stands on at least ``CONSTANT`` of all distinct pages
of the host, three at least; any other node is a slot.

Extraction aligns the page with its host's wrapper. Slots inside the content root (article, main or the
like, else the body) give the text. Template nodes, link lists and nodes that their markup marks as
menus, headers, footers, sidebars, notices, adverts, forms, scripts or reader comments are left out.
Words of class or id never drop an article, a main element or what holds them. Headings and paragraphs
are judged like other blocks, one by one also in a run of equal siblings; items of lists and cells of
tables only with their whole list or table.

Defined cases: null html gives an empty text; a page without a host, or alone on its host, is judged by
markup alone; near copies that differ in their longest block count as different pages; unclosed and stray
tags follow the usual recovery rules; markup may be nested to any depth; repeated rows give repeated rows; very long
pages are read whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_arrow, slices, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|</(?P<end>[a-zA-Z][^\s>/]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<odd>[a-zA-Z][^\s>/]*)[^>]*>",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = frozenset("class id role itemprop".split())
_WORTH = re.compile(r"class|id|role|itemprop|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: Opening one of these ends an open sibling of the same kind, up to its container.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that never hold the article.
DROPPED = frozenset("head script style noscript template svg math canvas iframe object embed audio video nav footer aside form button select input textarea label fieldset dialog menu title".split())
#: Words of class, id and role that mark other parts of a page.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside widget widgets rail footer header masthead topbar toolbar "
    "comment comments disqus reply replies respond discussion share sharing social follow related recommended recommendations newsletter subscribe subscription signup login search form "
    "copyright skip complementary contentinfo".split()
)
CONTENT = frozenset("article main content post entry story".split())
#: Words that make a class a state of a container ("has-sidebar"), not the name of a part.
STATES = frozenset("has have with without no is open closed enabled disabled fixed sticky layout".split())
#: Parts and elements whose articles are other people's: comments, teasers.
FOREIGN = frozenset("comment comments disqus reply replies respond discussion related recommended recommendations".split())
FOREIGN_TAGS = frozenset("nav footer aside dialog head template noscript".split())
#: Items and cells: one text on every page can be one of the values there.
_PARTS = frozenset("li td th dd dt".split())
#: Share of a host's distinct pages from which a text is template.
CONSTANT = 0.8
#: Share of a host's pages below which a node is no part of its wrapper.
RARE = 0.1
CHUNKS = 256
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "mark", "kids", "other", "root", "foreign", "digest", "letters", "linked")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids = tag, []
        words: list[str] = []
        marks: set[str] = set()
        hidden = False
        if attrs and _WORTH.search(attrs):
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), a or b or c
                if name in _NAMED:
                    for token in value.split():
                        own = [w.lower() for w in _SPLIT.split(token) if w]
                        words += own
                        if STATES.isdisjoint(own):
                            # the header of a post or an article holds its title
                            marks.update(own if "header" not in own or CONTENT.isdisjoint(own) else set(own) - {"header"})
                elif name == "hidden":
                    hidden |= value.lower() != "false"
                elif name == "aria-hidden":
                    hidden |= value.lower() == "true"
                elif name == "style" and _UNSEEN.search(value):
                    hidden = True
        self.mark = " ".join(words)
        whole = tag in ("article", "main")  # their own classes say nothing against them
        self.other = hidden or tag in DROPPED or (not whole and not MARKS.isdisjoint(marks))
        self.root = 3 if tag == "article" else 2 if tag == "main" else 1 if not CONTENT.isdisjoint(words) else 0
        self.foreign = hidden or tag in FOREIGN_TAGS or (not whole and not FOREIGN.isdisjoint(marks))
        self.digest = self.letters = self.linked = 0

    def key(self) -> tuple[str, str]:
        return self.tag, self.mark


def _stable(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def _signed(x: int) -> int:
    return (x ^ (1 << 63)) - (1 << 63)


def parse(page: str) -> Node:
    """DOM of a page with the usual error recovery; texts are plain strings among the children."""
    top = Node("html")
    stack = [top]
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        end = m["end"]
        if end:
            end = end.lower()
            if end == "p" and not any(n.tag == "p" for n in stack[1:]):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == end:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and end not in BLOCKS:
                    break
            continue
        tag = m["tag"] or m["odd"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:-3])
            continue
        tag = tag.lower()
        attrs = m["attrs"] or ""
        if tag in ("html", "body") and len(stack) == 1:
            if tag == "html":
                continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in _SIBLINGS:
            ended, bounds = _SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    del stack[k:]
                    break
                if stack[k].tag in bounds:
                    break
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
    return top


def _preorder(top: Node) -> list[Node]:
    """All elements that can hold text, parents first."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in node.kids if not isinstance(k, str) and k.tag not in RAW)
    return out


def measure(top: Node) -> list[Node]:
    """Sets digest (of tag, class and all text below), letters and linked letters of every element;
    returns the elements, parents first."""
    order = _preorder(top)
    for node in reversed(order):
        parts, letters, linked = [node.tag, node.mark], 0, 0
        for kid in node.kids:
            if isinstance(kid, str):
                text = " ".join(kid.split())
                if text:
                    parts.append(text)
                    letters += len(text)
            elif kid.tag not in RAW and kid.letters:
                parts.append(f"\0{kid.digest}")
                letters += kid.letters
                linked += kid.linked
        node.digest, node.letters = _stable("\1".join(parts)), letters
        node.linked = letters if node.tag == "a" else linked
    return order


# --- skeletons and wrappers ------------------------------------------------------------------


class Shape:
    """A wrapper node: what a run of equal siblings looks like over pages. ``code`` is a digest of the
    tree's structure, ``nodes`` its size."""

    __slots__ = ("key", "kids", "pages", "letters", "linked", "code", "nodes")

    def __init__(self, key: tuple[str, str], kids: list, letters: int, linked: int, pages: int = 1):
        self.key, self.kids = key, kids
        self.letters, self.linked, self.pages = letters, linked, pages
        self.seal()

    def seal(self) -> None:
        self.code = _stable("\0".join((*self.key, *[str(k.code) for k in self.kids])))
        self.nodes = 1 + sum(k.nodes for k in self.kids)


def _all(top: Shape) -> list[Shape]:
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(node.kids)
    return out


def dump(top: Shape) -> bytes:
    """A tree as a flat list of its nodes, so that depth does not matter."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append((*node.key, len(node.kids), node.pages, node.letters, node.linked))
        stack.extend(reversed(node.kids))
    return json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")


def load(raw: bytes) -> Shape:
    done: list[Shape] = []
    for tag, mark, n, pages, letters, linked in reversed(json.loads(raw)):
        kids = [done.pop() for _ in range(n)]
        done.append(Shape((tag, mark), kids, letters, linked, pages))
    return done[0]


def _is_block(kid: Node | str) -> bool:
    return not isinstance(kid, str) and kid.tag in BLOCKS and kid.tag not in DROPPED


def skeleton(top: Node) -> tuple[Shape, dict[int, list[tuple[Shape, list[Node]]]]]:
    """The page's tree of block elements with runs of equal siblings merged, and for every block its runs:
    the shape and its members. The page is measured."""
    blocks, stack = [], [top]
    while stack:
        node = stack.pop()
        blocks.append(node)
        stack.extend(k for k in node.kids if _is_block(k))
    shapes: dict[int, Shape] = {}
    runs: dict[int, list[tuple[Shape, list[Node]]]] = {}
    for node in reversed(blocks):
        own: list[tuple[Shape, list[Node]]] = []
        for kid in node.kids:
            if not _is_block(kid):
                continue
            shape = shapes.pop(id(kid))
            if own and own[-1][0].key == shape.key:
                merged = merge(own[-1][0], shape, pages=1)
                own[-1][1].append(kid)
                own[-1] = merged, own[-1][1]
            else:
                own.append((shape, [kid]))
        runs[id(node)] = own
        shapes[id(node)] = Shape(node.key(), [s for s, _ in own], node.letters, node.linked)
    return shapes[id(top)], runs


class Sizes(dict):
    """Nodes matched by the best alignment of two trees (zero if their roots differ), each pair of nodes
    computed once and without recursion."""

    def of(self, a: Shape, b: Shape) -> int:
        if (found := self.get((id(a), id(b)))) is not None:
            return found
        order, stack = [], [(a, b)]
        while stack:  # a pair follows the pair of its parents
            x, y = stack.pop()
            order.append((x, y))
            if x.key == y.key and x.code != y.code:
                stack.extend((p, q) for p in x.kids for q in y.kids if p.key == q.key and (id(p), id(q)) not in self)
        for x, y in reversed(order):
            if x.key != y.key:
                size = 0
            elif x.code == y.code:
                size = x.nodes
            else:
                row = [0] * (len(y.kids) + 1)
                for p in x.kids:
                    before = 0
                    for j, q in enumerate(y.kids, 1):
                        here = max(row[j], row[j - 1], before + (self[id(p), id(q)] if p.key == q.key else 0))
                        before, row[j] = row[j], here
                size = 1 + row[-1]
            self[id(x), id(y)] = size
        return self[id(a), id(b)]


def match(a: list[Shape], b: list[Shape], sizes: Sizes) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the order-preserving pairs of most matched nodes."""
    if not a or not b:
        return []
    if len(a) == len(b) and all(x.code == y.code for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    weight = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = [[sizes.of(x, y) if x.key == y.key else 0 for y in b] for x in a]
    for i in range(1, len(a) + 1):
        row, above = weight[i], weight[i - 1]
        for j in range(1, len(b) + 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + gain[i - 1][j - 1])
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if gain[i - 1][j - 1] and weight[i][j] == weight[i - 1][j - 1] + gain[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif weight[i][j] == weight[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def merge(a: Shape, b: Shape, pages: int | None = None) -> Shape:
    """Two trees of equal roots as one. ``pages``: the count of every aligned node (else the sum)."""
    sizes, made = Sizes(), []
    top = Shape(a.key, [], 0, 0)
    stack = [(a, b, top)]
    while stack:
        x, y, out = stack.pop()
        out.letters, out.linked, out.pages = x.letters + y.letters, x.linked + y.linked, pages or x.pages + y.pages
        made.append(out)
        i = j = 0
        for p, q in [*match(x.kids, y.kids, sizes), (len(x.kids), len(y.kids))]:
            out.kids += x.kids[i:p]
            out.kids += y.kids[j:q]
            if p < len(x.kids):
                child = Shape(x.kids[p].key, [], 0, 0)
                out.kids.append(child)
                stack.append((x.kids[p], y.kids[q], child))
            i, j = p + 1, q + 1
    for node in reversed(made):
        node.seal()
    return top


def prune(top: Shape) -> Shape:
    """Without the nodes on fewer than ``RARE`` of the pages."""
    order = _all(top)
    for node in order:
        node.kids = [k for k in node.kids if k.pages >= RARE * top.pages]
    for node in reversed(order):
        node.seal()
    return top


# --- extraction ------------------------------------------------------------------------------


def _judged(node: Node) -> bool:
    """Nodes that may be template by their text."""
    return node.tag not in _PARTS and node.tag != "body" and not node.root


def _roots(top: Node) -> list[Node]:
    """The outermost content roots of the best kind: articles, else main elements, neither in foreign
    parts, else nodes named as content; of one kind those inside the fewest marked nodes."""
    best: dict[int, tuple[int, list[Node]]] = {}
    stack: list[tuple[Node, int, int]] = [(top, 0, 0)]
    while stack:
        node, marked, held = stack.pop()
        for kid in reversed(node.kids):
            if isinstance(kid, str) or kid.tag in RAW or kid.foreign:
                continue
            if kid.root > held and (kid.root > 1 or not (kid.other or marked)):
                known = best.get(kid.root)
                if known is None or marked < known[0]:
                    best[kid.root] = marked, [kid]
                elif marked == known[0]:
                    known[1].append(kid)
            stack.append((kid, marked + kid.other, max(held, kid.root)))
    found = best[max(best)][1] if best else [top]
    if len(found) > 1:  # in page order
        place = {id(n): k for k, n in enumerate(_page_order(top))}
        found.sort(key=lambda n: place[id(n)])
    return found


def _page_order(top: Node) -> list[Node]:
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    return out


def _template(top: Node, wrapper: Shape, constant: frozenset[int]) -> set[int]:
    """Ids of the page's nodes that align with the wrapper and are template, or lists of links."""
    shape, runs = skeleton(top)
    out: set[int] = set()
    sizes = Sizes()
    stack = [(top, wrapper)] if shape.key == wrapper.key else []
    while stack:
        node, known = stack.pop()
        own = runs[id(node)]
        for x, y in match([s for s, _ in own], known.kids, sizes):
            like = known.kids[y]
            links = like.letters and like.linked >= 0.8 * like.letters and like.pages >= 2
            for kid in own[x][1]:
                if _judged(kid) and _signed(kid.digest) in constant and kid.letters:
                    out.add(id(kid))
                elif links and kid.tag in ("ul", "ol", "dl", "table"):
                    out.add(id(kid))
                else:
                    stack.append((kid, like))
    return out


def extract(page: str | None, wrapper: Shape | None, constant: frozenset[int] = frozenset()) -> str:
    """Main text of one page; blocks in page order joined by line feeds. ``constant``: the digests of the
    blocks that stand on nearly all of the host's distinct pages."""
    if not page:
        return ""
    top = parse(page)
    if wrapper is None or wrapper.pages < 2:
        return _text(top, set())
    measure(top)
    return _text(top, _template(top, wrapper, constant))


def _text(top: Node, skip: set[int]) -> str:
    roots = _roots(top)
    whole = roots == [top]  # no content root: the page's header is no part of the text
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    for root in roots:
        stack: list = [(root, iter(root.kids))]
        while stack:
            node, kids = stack[-1]
            kid = next(kids, None)
            if kid is None:
                stack.pop()
                if node.tag in BLOCKS:
                    flush()
            elif isinstance(kid, str):
                held.append(kid)
            elif kid.tag == "br":
                held.append(" ")
            elif id(kid) in skip or (kid.other and kid.tag != "body" and not (kid.tag == "header" and node.root)) or (whole and kid.tag == "header"):
                if kid.tag in BLOCKS:
                    flush()
            else:
                if kid.tag in BLOCKS:
                    flush()
                stack.append((kid, iter(kid.kids)))
        flush()
    return "\n".join(out)


# --- tables ----------------------------------------------------------------------------------


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))


def _distinct_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeleton and marks of the pages of a task, one a host and longest block."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("wrapper", pa.binary()), ("marks", pa.list_(pa.int64()))])
    seen: dict[tuple[str, int], tuple[bytes, list[int]]] = {}
    for batch in slices(batches, "html"):
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not (host and page):
                continue
            top = parse(page)
            text = _text(top, set())
            same = _signed(_stable(max(text.split("\n"), key=lambda t: (len(t), t)) or page))
            nodes = measure(top)
            marks = sorted({_signed(n.digest) for n in nodes if n.letters and n.tag in BLOCKS and _judged(n)})
            shape = dump(skeleton(top)[0])
            known = seen.get((host, same))
            if known is None or (shape, marks) < known:  # the least of the copies stands for them
                seen[host, same] = shape, marks
                rows.append((host, same, shape, marks))
        if len(seen) > 100_000:
            seen.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_FOLDED = "host string, code long, wrapper binary"


def _rows(rows: list[tuple[str, int, Shape]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([dump(r[2]) for r in rows], pa.binary())], ["host", "code", "wrapper"])


def _add_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeletons of equal structure add up, which no order changes."""
    held: dict[tuple[str, int], Shape] = {}
    for batch in batches:
        for host, raw in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
            shape = load(raw)
            key = host, _signed(shape.code)
            held[key] = merge(held[key], shape) if key in held else shape
        if len(held) >= 5000:
            yield _rows([(h, c, s) for (h, c), s in held.items()])
            held = {}
    if held:
        yield _rows([(h, c, s) for (h, c), s in held.items()])


def _fold(level: str):
    """Rows sorted by host, part and code: the trees of each part (or host) become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shape = None, None
        for batch in batches:
            parts = [c % CHUNKS for c in batch.column("code").to_pylist()] if level == "part" else [0] * batch.num_rows
            for host, part, raw in zip(batch.column("host").to_pylist(), parts, batch.column("wrapper").to_pylist()):
                if (host, part) == now:
                    shape = merge(shape, load(raw))
                else:
                    if shape is not None:
                        yield _rows([(*now, shape)])
                    now, shape = (host, part), load(raw)
        if shape is not None:
            yield _rows([(*now, shape)])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield _rows([(h, c, prune(load(w))) for h, c, w in zip(*[x.to_pylist() for x in batch.columns])])

    return run if level == "part" else last


def induce(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (:func:`dump`), ``constant`` (digests of blocks) for every host of ``pages``."""
    copies = map_arrow(_with_host(pages).select("host", "html"), _distinct_pages, "host string, page long, wrapper binary, marks array<long>")
    one = copies.groupBy("host", "page").agg(F.min(F.struct("wrapper", "marks")).alias("_one")).select("host", "page", "_one.*")
    one = durable(one, "distinct-pages")
    equal = map_arrow(one.select("host", "wrapper"), _add_equal, _FOLDED)
    equal = map_arrow(equal.repartition("host", "code").sortWithinPartitions("host", "code"), _add_equal, _FOLDED)
    part = F.pmod("code", F.lit(CHUNKS))
    parts = map_arrow(equal.repartition("host", part).sortWithinPartitions("host", part, "code"), _fold("part"), _FOLDED)
    folded = map_arrow(parts.repartition("host").sortWithinPartitions("host", "code"), _fold("host"), _FOLDED).drop("code")
    # a host has at most its blocks a page over CONSTANT of these
    counts = one.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).where("n >= 3")
    totals = one.groupBy("host").agg(F.count("*").alias("pages"))
    constant = counts.join(totals, "host").where(F.col("n") >= CONSTANT * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_set("mark")).alias("constant"))
    return folded.join(constant, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    wrappers = durable(induce(pages), "wrappers")
    rows = _with_host(pages).join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Shape | None, frozenset[int]]] = {}
        for batch in slices(batches, "html"):
            texts = []
            wrapper, constant = batch.column("wrapper"), batch.column("constant")
            for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                if host not in known:  # read once a host and task
                    if len(known) >= 1000:
                        known.clear()
                    raw = wrapper[i].as_py()
                    known[host] = load(raw) if raw else None, frozenset(constant[i].as_py() or ())
                texts.append(extract(page, *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
