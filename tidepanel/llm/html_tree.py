"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a node with a hidden label, content or not. Node potentials weigh what the element shows (tag, class and
id words, link share, text length, depth); edge potentials weigh the labels of parent and child. Sum-product messages run
upward from the leaves and downward from the root, which gives each node's exact marginal on the tree; text belongs to
the page's content where its block's marginal is over one half.

The potentials are trained on the pages themselves, labelled where the mark-up says what is what: an element inside an
article (or main) element, but not inside a part that is boiler-plate by name, is content. Counts of (observation, label)
and (parent label, child label) over all labelled pages are summed on Spark; smoothed log ratios are the potentials. The
table of observations is bounded: names are hashed into NAME_SLOTS slots, the rest is binned.

Null, empty or text-free html gives an empty text; unclosed and stray tags are tolerated. A tag ends at the first > outside
quotes; once a quote is found to be left open to the page's end, quotes no longer count on that page, and where no > follows, a <
is text. So each page is read in time linear in its length, however long, deep or broken it is. Only elements without content
close by themselves, whatever slash they hold. Without any labelled page the priors decide by tag name alone. Repeated rows give
a row each. Columns besides page_id, url and html are not read. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, elements whose text is not text, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER_TAGS = frozenset("nav footer aside header form script style noscript template button select dialog".split())
BOILER_NAMES = frozenset("ad ads advert advertisement banner sponsored promo comment comments reply replies cookie consent notice popup modal nav menu navbar sidebar footer header breadcrumb breadcrumbs related share social subscribe newsletter widget pagination copyright".split())
NAME_SLOTS = 512

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_END = {tag: re.compile(f"</{tag}", re.I) for tag in ("script", "style")}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "parent", "parts", "chars", "linked", "boiler", "inside", "raw", "block")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None) -> None:
        self.tag, self.names, self.parent = tag, names, parent
        self.parts: list[tuple[int, str]] = []  # own text with its place in the page
        self.chars = self.linked = 0
        self.raw = tag in RAW or (parent.raw if parent else False)
        self.boiler = (parent.boiler if parent else False) or tag in BOILER_TAGS or any(x in BOILER_NAMES for x in names)
        self.inside = (parent.inside if parent else False) or tag in ("article", "main")
        self.block = self if parent is None or tag in BLOCK else parent.block  # the nearest block around its text


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start and end of each piece of mark-up: '/' or '', name and attributes of a tag, or three empty strings. The reader
    sends where to go on."""
    at, size, quotes = 0, len(page), True
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        slash = name = rest = ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = size if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", start) + 1
        elif m := _NAME.match(page, start):
            slash, name = m.group(1), m.group(2).lower()
            closed = _REST.match(page, m.end()) if quotes else None
            if closed:
                end = closed.end()
            else:
                quotes = False
                end = page.find(">", m.end()) + 1
            rest = page[m.end() : end - 1]
        else:
            at = start + 1
            continue
        if end == 0:  # no > from here on
            return
        on = yield start, end, slash, name, rest
        at = end if on is None else on


def parse_page(page: str) -> list[Node]:
    """The page's elements, parents before children. Only text of whole tags is mark-up; the rest is text."""
    root = Node("html", (), None)
    nodes, now, place, done = [root], root, 0, 0
    unclosed: Counter = Counter()

    def close(up: Node) -> Node:
        """Closes all from the innermost element to `up`."""
        node = now
        while True:
            unclosed[node.tag] -= 1
            if node is up:
                return up.parent or root
            node = node.parent

    tokens = _tokens(page)
    go_on: int | None = None
    while True:
        try:
            start, end, slash, tag, rest = tokens.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > done:
            now.parts.append((place, page[done:start]))
            place += 1
        done = end
        if not tag or tag == "html":
            continue
        if slash:
            if unclosed[tag]:
                up = now
                while up.tag != tag:
                    up = up.parent
                now = close(up)
            continue
        if tag in BLOCK:
            up = now.block
            if up.parent is not None and (up.tag == "p" or tag == up.tag and tag in ("li", "dd", "dt", "tr", "td", "th")):
                now = close(up)
        names = tuple(w for a in _ATTR.finditer(rest) for w in _WORD.findall(a.group(2).lower())) if rest else ()
        node = Node(tag, names, now)
        nodes.append(node)
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                now.parts.append((place, " "))
                place += 1
            continue
        if tag in _END:
            found = _END[tag].search(page, end)
            done = go_on = found.start() if found else len(page)
        now = node
        unclosed[tag] += 1
    if done < len(page):
        now.parts.append((place, page[done:]))
    for node in reversed(nodes):
        own = 0 if node.raw else sum(len(t.strip()) for _, t in node.parts)
        node.chars += own
        if node.tag == "a":
            node.linked = node.chars
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return nodes


def observations(node: Node) -> list[str]:
    """What a node shows. article and main name what is sought, so as tags they are not shown."""
    tag = "div" if node.tag in ("article", "main") else node.tag
    share = node.linked / node.chars if node.chars else 0
    up = node.parent.tag if node.parent else "-"
    up = "div" if up in ("article", "main") else up
    return [f"t:{zlib.crc32(tag.encode()) % NAME_SLOTS}", f"u:{zlib.crc32(up.encode()) % NAME_SLOTS}", f"l:{int(share * 4)}", f"c:{min(7, int(math.log2(node.chars + 1) / 2))}", *(f"n:{zlib.crc32(x.encode()) % NAME_SLOTS}" for x in sorted(set(node.names)))]


def label(node: Node) -> int:
    return int(node.inside and not node.boiler and not node.raw)


def train(pages: DataFrame) -> dict[str, tuple[float, float]]:
    """Log potentials (not content, content) by observation, and by 'e0', 'e1' (parent's label) for the child's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                nodes = parse_page(page or "")
                if not any(x.inside for x in nodes):
                    continue
                for node in nodes:
                    y = label(node)
                    counts["y", y] += 1
                    for o in observations(node):
                        counts[o, y] += 1
                    if node.parent:
                        counts[f"e{label(node.parent)}", y] += 1
        yield pa.RecordBatch.from_pydict({"o": pa.array([k[0] for k in counts], pa.string()), "y": pa.array([k[1] for k in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = pages.select("html").mapInArrow(run, "o string, y int, n long").groupBy("o", "y").agg(F.sum("n").alias("n")).collect()
    n = {(r.o, r.y): r.n for r in rows}
    if not n:
        return _prior()
    totals = [n.get(("y", y), 0) + 2 for y in (0, 1)]
    model = {o: tuple(math.log((n.get((o, y), 0) + 0.5) / totals[y]) for y in (0, 1)) for o in {k[0] for k in n} if o != "y" and o[0] != "e"}
    for e in ("e0", "e1"):
        both = [n.get((e, y), 0) + 0.5 for y in (0, 1)]
        model[e] = tuple(math.log(x / sum(both)) for x in both)
    model["y"] = tuple(math.log(x / sum(totals)) for x in totals)
    return _prior() | model  # names that no labelled page shows keep their prior


def _prior() -> dict[str, tuple[float, float]]:
    model = {"y": (math.log(0.5), math.log(0.5)), "e0": (math.log(0.6), math.log(0.4)), "e1": (math.log(0.1), math.log(0.9))}
    for tag in BOILER_TAGS:
        model[f"t:{zlib.crc32(tag.encode()) % NAME_SLOTS}"] = (math.log(0.3), math.log(0.003))
    for name in BOILER_NAMES:
        model[f"n:{zlib.crc32(name.encode()) % NAME_SLOTS}"] = (math.log(0.3), math.log(0.003))
    for tag in ("p", "h1"):
        model[f"t:{zlib.crc32(tag.encode()) % NAME_SLOTS}"] = (math.log(0.05), math.log(0.3))
    return model


def _add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def marginals(nodes: list[Node], model: dict[str, tuple[float, float]]) -> list[float]:
    """P(content) of each node by sum-product: messages up from the leaves, then down from the root."""
    n = len(nodes)
    place = {id(x): k for k, x in enumerate(nodes)}
    parent = [place[id(x.parent)] if x.parent else -1 for x in nodes]
    none = (0.0, 0.0)
    e = (model["e0"], model["e1"])
    up0, up1 = [0.0] * n, [0.0] * n  # node potential times the messages from the children
    for k, x in enumerate(nodes):
        for o in observations(x):
            w = model.get(o, none)
            up0[k] += w[0]
            up1[k] += w[1]
    up0[0] += model["y"][0]
    up1[0] += model["y"][1]
    sent = [none] * n
    for k in range(n - 1, 0, -1):
        sent[k] = (_add(e[0][0] + up0[k], e[0][1] + up1[k]), _add(e[1][0] + up0[k], e[1][1] + up1[k]))
        up0[parent[k]] += sent[k][0]
        up1[parent[k]] += sent[k][1]
    b0, b1 = up0[:], up1[:]  # beliefs
    for k in range(1, n):
        p = parent[k]
        rest0, rest1 = b0[p] - sent[k][0], b1[p] - sent[k][1]
        b0[k] += _add(rest0 + e[0][0], rest1 + e[1][0])
        b1[k] += _add(rest0 + e[0][1], rest1 + e[1][1])
        top = max(b0[k], b1[k])
        b0[k] -= top
        b1[k] -= top
    return [1 / (1 + math.exp(min(700.0, b0[k] - b1[k]))) for k in range(n)]


def main_text(page: str, model: dict[str, tuple[float, float]]) -> str:
    nodes = parse_page(page)
    keep = {id(x) for x, p in zip(nodes, marginals(nodes, model), strict=True) if p > 0.5}
    runs: list[tuple[int, Node, str]] = []
    for x in nodes:
        if x.raw:
            continue
        block = x.block
        if id(x) in keep or (x is not block and id(block) in keep and x.tag not in BOILER_TAGS and not any(w in BOILER_NAMES for w in x.names)):
            runs += [(place, block, text) for place, text in x.parts]
    runs.sort(key=lambda r: r[0])
    blocks: list[list[str]] = []
    last, last_place = None, -2
    for place, block, text in runs:
        if block is not last or (place != last_place + 1 and block is not last):
            blocks.append([])
        blocks[-1].append(text)
        last, last_place = block, place
    lines = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, model: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(train(pages) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", sent.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = pages.select("page_id", "url").schema
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long")
