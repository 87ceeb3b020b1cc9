"""Main text of web pages by composite text density (operator 8).

A page is read into a tree; every node gets its characters per tag, adjusted by how many of the characters and tags are
links: density = C/T * log_b(C/LC * T/LT), b = ln(C/(C-LC) * LC + LC_page/C_page * C + e). A node's sum of its children's
densities grows where dense blocks stand side by side. The least density on the path from the node of greatest sum to
the body is the threshold: that node and every other one that reaches the threshold is main text, after elements that
say what they are (menus, headers of the page, footers, asides, forms that don't hold the page, scripts, adverts, notices, comments) have gone.
What stands beside those nodes and isn't mostly links, and headings before them, go with them; within them nodes of
lower density that consist mostly of links go. Article and main elements have no say in this. Class and id names are
evidence only: nothing goes by name that holds the node of greatest sum or most of the page's text outside links (unless that is short), and
names that may as well be an article's words (HINTS) count only for what is mostly links or both short and not dense.

Reading a page takes time in proportion to its length, however its tags nest or break.

Cases: a null page counts as empty; a page without text gives an empty text; a very long one is read whole; unclosed and
stray tags are closed or ignored as browsers do in the common cases, and a tag that the page ends in is dropped; equal sums go to the earlier node; repeated rows give equal rows; an empty
table gives an empty result; further columns don't pass.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellsift.llm.common import lean, table
from cellsift.llm.markup import CLOSE, INNER, TEXT as WORDS, attributes, scan

SPACE = re.compile(r"\s+")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dt dd caption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: An open element that ends where the named one begins, unless a wall stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
WALLS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
SCOPE = frozenset("table td th caption html body article section div aside nav main footer header form button li dd dt blockquote".split())
#: Elements that are never main text.
GONE = frozenset("nav footer aside script style noscript iframe template svg math object embed applet select button input textarea menu dialog canvas audio video head title noframes xmp datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split())
#: Parts of class and id names that say what an element is, however much it holds.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promoted promotions nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs footer masthead topbar bottombar toolbar sidebar "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr popup modal overlay lightbox subscribe newsletter signup login signin paywall searchbox pagination pager tagcloud toc".split()
)
#: Parts that are as often an article's own words; they count where an element is short and not dense, or mostly links.
HINTS = frozenset(
    "promotion foot side aside reply discussion discuss notice notices notification notifications alert alerts dialog subscription register share sharing social follow "
    "related recommended recommendations recommend popular trending widget widgets search paging tags skip legal copyright disclaimer feedback rating poll".split()
)
#: After these a name says what its element has or lacks.
MODIFIERS = frozenset("has with no without not".split())
UNSEEN = frozenset("hidden is-hidden visually-hidden".split())
#: Characters under which an element is short.
SHORT = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text.
TEXT = HEADINGS | frozenset("p ul ol dl pre blockquote table figure section hgroup".split())
#: Elements whose class names are about the whole page.
WHOLE = frozenset("html body main article".split())
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "children", "gone", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, gone: bool, named: int = 0):
        self.tag, self.children, self.gone, self.named = tag, [], gone, named
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def named(value: str) -> int:
    """What a class or id says of its element: 2 that it isn't main text, 1 that it may not be, 0 nothing."""
    found = 0
    for name in value.split():
        if name.lower() in UNSEEN:
            return 2
        if ":" in name:  # a style for some screens
            continue
        for w in CAMEL.findall(name):
            w = w.lower()
            if w in MODIFIERS:
                break
            if w in NAMES:
                return 2
            if w in HINTS:
                found = 1
    return found


def unwanted(tag: str, text: str, inside: bool) -> tuple[bool, int]:
    """Whether an element isn't main text, and what its names say. inside: it stands in an article or main element, where a header is the text's own."""
    if tag in GONE:
        return True, 0
    if tag == "header" and not inside:
        return True, 0
    says = 2 if tag == "form" else 0  # some pages stand in one as a whole
    if not text or tag in WHOLE or "=" not in text and "hidden" not in text:
        return False, says
    for name, value in attributes(text):
        if name == "hidden" and (value is None or value.lower() in ("", "hidden", "true", "until-found")) or name == "aria-hidden" and value is not None and value.lower() == "true":
            return True, 0
        if value is None:
            continue
        if name == "role" and value.lower() in ROLES:
            return True, 0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0
        if name in ("class", "id"):
            says = max(says, named(value))
    return False, says


class Open:
    """The open elements, with the depths of those of each name, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.scopes = [root], [0]
        self.depths: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all within it."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def last(self, *tags: str) -> int:
        """Depth of the innermost of these; 0 if none is open."""
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)

    def close(self, tag: str) -> None:
        wall = self.scopes[-1] if tag in INLINE else self.last("article", "section", "main", "table", "body") if tag in ("p", "li", "td", "th", "dd", "dt") else 0
        if self.last(tag) > wall:
            self.cut(self.last(tag))

    def make_way(self, tag: str) -> None:
        """Close what ends where this element begins."""
        if tag in CLOSES_P and self.last("p") > self.scopes[-1]:
            self.cut(self.last("p"))
        if tag in ENDS:
            wall = self.last(*WALLS[tag])
            over = [d[k] for t in ENDS[tag] if (d := self.depths[t]) and (k := bisect_right(d, wall)) < len(d)]
            if over:
                self.cut(min(over))


def parse(page: str) -> Node:
    root = Node("#page", False)
    open_ = Open(root)
    for kind, tag, value in scan(page, RAW):
        if kind == WORDS:
            open_.stack[-1].children.append(value)
        elif kind == CLOSE:
            open_.close(tag)
        elif kind != INNER:
            open_.make_way(tag)
            node = Node(tag, *unwanted(tag, value, bool(open_.last("article", "main"))))
            open_.stack[-1].children.append(node)
            if tag not in VOID and tag not in RAW and not (value.endswith("/") and tag not in BLOCK and tag not in INLINE):
                open_.push(node)
    return root


def drop(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not c.gone]
        todo.extend(c for c in node.children if not isinstance(c, str))


def in_order(root: Node) -> list[tuple[Node, list[Node]]]:
    """Every node with the nodes above it, parents first."""
    out, todo = [], [(root, ())]
    while todo:
        node, above = todo.pop()
        out.append((node, above))
        todo.extend((c, (node, above)) for c in reversed(node.children) if not isinstance(c, str))
    return out


def measure(root: Node) -> list[tuple[Node, tuple]]:
    nodes = in_order(root)
    linked = set()
    for node, above in nodes:
        node.clear()
        if node.tag == "a" or above and above[0] in linked:
            linked.add(node)
    for node, above in reversed(nodes):
        own = sum(len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        if node in linked:
            node.link_chars += own
        if above:
            up = above[0]
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    share = root.link_chars / root.chars if root.chars else 0.0
    for node, above in reversed(nodes):
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = max(0.0, c / t * math.log(max(c, 1) / max(lc, 1) * t / lt) / math.log(base)) if base > 1 else c / t
        if above:
            above[0].sum += node.density
    return nodes


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks in page order."""
    out, run = [], []

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x is not node and x.tag in BLOCK and x.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote") and x.chars and x.density < threshold and x.link_chars * 2 > x.chars:
            close()
        elif x.tag in BLOCK:
            close()
            todo.append(None)
            todo.extend(reversed(x.children))
        elif x.tag == "br":
            run.append(" ")
        else:
            todo.extend(reversed(x.children))
    close()
    return out


def densest(nodes: list[tuple[Node, tuple]], body: Node) -> tuple[Node, tuple, float]:
    """The node of greatest sum, the nodes above it, and the least density from it to the body."""
    best, path = None, ()
    for node, above in nodes:
        if node.tag in INLINE or node is not body and node.tag in ("html", "#page"):
            continue
        if best is None or node.sum > best.sum:
            best, path = node, above
    least, up = best.density, path
    while up:
        if up[0].tag not in ("html", "#page"):
            least = min(least, up[0].density)
        up = up[1]
    return best, path, least


def upwards(path: tuple) -> set[Node]:
    out = set()
    while path:
        out.add(path[0])
        path = path[1]
    return out


def mostly_links(node: Node) -> bool:
    return node.link_chars * 2 > node.chars


def headed(node: Node) -> bool:
    return node.tag in HEADINGS or node.tag in ("header", "hgroup") and any(not isinstance(c, str) and c.tag in HEADINGS for c in node.children)


def keep(nodes: list[tuple[Node, tuple]], body: Node, best: Node, path: tuple, least: float) -> None:
    """Leave in the tree the dense nodes and what stands with them."""
    held = upwards(path)
    whole = {best}
    for node, above in nodes:  # parents first
        if above and above[0] in whole or node not in held and node.tag not in INLINE and node.chars and node.density >= least:
            whole.add(node)
    count = dict.fromkeys((n for n, _ in nodes), 0)
    for node, above in reversed(nodes):
        if node in whole and not (above and above[0] in whole):
            count[node] = 1
        if above:
            count[above[0]] += count[node]
    total = count[nodes[0][0]]
    for node, _ in nodes:
        if node in whole or not count[node]:
            continue
        # In the least node that holds all dense ones, or a dense paragraph, their neighbours are text too; above it only headings before them.
        dense = [c for c in node.children if not isinstance(c, str) and c in whole]
        beside = bool(dense)
        inner = all(isinstance(c, str) or count[c] < total for c in node.children) or any(c.tag in TEXT and c.tag != "section" for c in dense)
        out, run, begun = [], [], False

        def settle() -> None:
            chars = sum(len(SPACE.sub(" ", c).strip()) if isinstance(c, str) else c.chars for c in run)
            if chars and inner and beside and sum(0 if isinstance(c, str) else c.link_chars + (c.tag == "a") for c in run) * 2 <= chars:
                out.extend(run)
            elif run:
                out.append(Node("div", False))  # text doesn't join over what is left out
            run.clear()

        for c in node.children:
            if isinstance(c, str) or c.tag in INLINE and not count[c]:
                run.append(c)
                continue
            settle()
            if count[c]:
                begun = True
                out.append(c)
            elif headed(c) and not mostly_links(c) and (inner or not begun and node is not body) or inner and beside and not mostly_links(c) and (node is not body or c.tag in TEXT):
                out.append(c)
            else:
                out.append(Node("div", False))
        settle()
        node.children, node.density = out, math.inf


def dismiss(nodes: list[tuple[Node, tuple]], body: Node, best: Node, path: tuple, least: float) -> bool:
    """Mark as gone what names speak against, but nothing that holds the best node or, unless it is short, most of the page's text outside links."""
    safe = upwards(path) | {best}
    text = body.chars - body.link_chars
    some = False
    for node, _ in nodes:
        if not node.named or node in safe or (node.chars - node.link_chars) * 2 > text and node.chars >= SHORT:
            continue
        if node.named == 2 or mostly_links(node) or node.density < least and node.chars < SHORT:
            node.gone = some = True
    return some


def main_text(page: str | None) -> str:
    root = parse(page or "")
    drop(root)
    nodes = measure(root)
    body = next((x for x, _ in nodes if x.tag == "body"), root)
    if not body.chars:
        return ""
    best, path, least = densest(nodes, body)
    if dismiss(nodes, body, best, path, least):
        drop(root)
        nodes = measure(root)
        best, path, least = densest(nodes, body)
    keep(nodes, body, best, path, least)
    return "\n\n".join(blocks(body, least))


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    schema = f"`{page_id}` {df.schema[page_id].dataType.simpleString()}, `{url}` {df.schema[url].dataType.simpleString()}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                part = whole.slice(k, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[page_id, url, "text", "n_chars"])

    return df.select(page_id, url, df[page].cast("string").alias("__html")).mapInArrow(lean(run), schema)


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_text_density": op8_text_density}
SQL: dict[str, str] = {}
