"""Main text of web pages by composite text density.

A page is read into a tree of block elements; inline elements only count as
tags of the block that holds them. Every node's density is its characters per
tag, adjusted for links: with C characters, T tags, LC link characters and LT
link tags,

    density = C/T * log(C/LC * T/LT) / log(ln(C/nLC * LC + LCb/Cb * C + e))

where nLC are the characters outside links and LCb/Cb is the link share of the
body; zero counts stand as one. A node's density sum adds the densities of its
child blocks and that of its own text. The block with the largest sum is the
main one; the least density on its path to the body is the threshold. The
result is lifted to the outermost article or main element around that block,
which stays whole. Beside it, subtrees stay that reach the threshold, that hold
another article, or that hold the title (an h1) where the article has none.
On a page without such an element all of the body stays but what is mostly
links: the search goes down into such a block and keeps the parts that aren't.

Elements that can't hold main text by their tag, role, class or id (menus,
headers and footers of the page, sidebars, adverts, notices, forms, comments,
scripts) are taken out first, so their text has no density. One that is named
so by class or id alone stays if an article lies within (a wrapper called
has-sidebar), or if it holds most of a page that has no such element, readers'
comments excepted: a name only weighs, where the text says otherwise. The same
goes for a form or an object around the page. Inline elements within running
text keep their words whatever they are called, links excepted.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(script|style|noscript|template|iframe|textarea|title|xmp)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WHITE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table caption thead tbody tfoot tr td th address details summary center header hgroup fieldset form object".split()
)
DROP = frozenset("head nav footer aside button select option input textarea script style noscript template iframe embed svg canvas audio video menu dialog label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations widget toolbar pagination pager form".split()
)
#: Longer names that begin so are furniture too (sidebarLeft, advertbox).
DROP_STARTS = ("sidebar", "advert", "cookie", "footer", "breadcrumb", "sponsor", "newsletter", "navbar", "navigation", "disqus", "popup", "comments", "commentlist", "commentsection", "commentbox")
#: Wrappers that are furniture unless the page's text lies within.
WRAPPERS = frozenset(["form", "object"])
#: Blocks of running text: a name on an inline element within says nothing of its words.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote figcaption caption pre".split())
#: What names a reader's comment, also on an article element.
COMMENT_WORDS = frozenset("comment comments reply replies respond".split())
#: What names a page's own top, outside an article.
TOP_WORDS = frozenset("header topbar".split())
#: A start tag closes an open element of these, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}


class Node:
    __slots__ = ("tag", "parent", "kids", "text", "chars", "tags", "link_chars", "link_tags", "own_chars", "own_tags", "own_link_chars", "own_link_tags", "density", "sum", "dropped")

    def __init__(self, tag: str, parent: "Node | None", dropped: int):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.kids: list[Node] = []
        self.text: list = []  # strings and Nodes in page order
        self.own_chars = self.own_tags = self.own_link_chars = self.own_link_tags = 0
        self.density = self.sum = 0.0


HARD, SOFT, COMMENT = 1, 2, 3


def _dropped(tag: str, attrs: str, in_article: bool) -> int:
    """HARD: taken out by its tag, role or hidden state. SOFT: by its class or id, unless the main text lies within. COMMENT: so, as a reader's. 0: stays."""
    if tag in DROP or (tag == "header" and not in_article):
        return HARD
    out = SOFT if tag in WRAPPERS else 0
    if not attrs or tag in ("html", "body", "main"):
        return out
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words = re.split(r"[^a-z0-9]+", value)
            if tag == "article":
                named = False
            else:
                named = not DROP_WORDS.isdisjoint(words) or any(w.startswith(DROP_STARTS) for w in words) or (not in_article and not TOP_WORDS.isdisjoint(words))
            out = COMMENT if not COMMENT_WORDS.isdisjoint(words) or any(w.startswith("comment") for w in words) else max(out, SOFT) if named else out
        elif (name == "role" and value in DROP_ROLES and tag not in ("article", "form")) or (tag != "article" and name == "aria-hidden" and value == "true") or (name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value))):
            return HARD
    return out


def _pruned(root: Node) -> Node:
    """root without the soft-dropped subtrees that hold no article or main element which stays, nor most of a page without one."""
    nodes = _order(root)
    holds: set[int] = set()
    if not any(n.tag in ("article", "main") and not n.dropped for n in nodes):
        for n in reversed(nodes):
            n.chars = n.own_chars + sum(k.chars for k in n.kids)
        for n in nodes:
            if n.dropped == SOFT and 2 * n.chars > root.chars:
                n.dropped = 0
    for n in reversed(nodes):
        if any(id(k) in holds for k in n.kids) or (n.tag in ("article", "main") and not n.dropped):
            holds.add(id(n))
    for n in nodes:
        if any(k.dropped and id(k) not in holds for k in n.kids):
            n.kids = [k for k in n.kids if not k.dropped or id(k) in holds]
            n.text = [x for x in n.text if not isinstance(x, Node) or not x.dropped or id(x) in holds]
    return root


def parse(page: str) -> Node:
    """The tree of blocks, dropped subtrees left out. Unclosed and stray tags are mended as browsers do."""
    root = Node("body", None, 0)
    stack: list[tuple[str, Node | None]] = [("body", root)]  # open elements; inline ones have no node
    opened: Counter[str] = Counter()  # so that what isn't open isn't looked for
    node, gone, links, articles = root, 0, 0, 0
    at = 0

    def push(name: str, own: Node | None) -> None:
        stack.append((name, own))
        opened[name.lstrip("!")] += 1

    def close(down_to: int) -> None:
        nonlocal node, gone, links, articles
        while len(stack) > down_to:
            tag, own = stack.pop()
            opened[tag.lstrip("!")] -= 1
            if own is None:
                if tag == "a":
                    links -= 1
                elif tag.startswith("!"):
                    gone -= 1
                continue
            if tag in ("article", "main"):
                articles -= 1
            node = own.parent or root

    def text(piece: str) -> None:
        if gone or not piece:
            return
        node.text.append(piece)
        n = len(_WHITE.sub("", piece))
        node.own_chars += n
        if links:
            node.own_link_chars += n

    for m in _TOKEN.finditer(page):
        if m.start() > at and not gone:
            text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[3] is None:
            if m[0].startswith("<![CDATA[") and not gone:
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[3].lower()
        if m[2]:  # an end tag
            if tag == "a" and not opened[tag]:
                tag = "anchor"  # one that leads nowhere
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                name = stack[i][0].lstrip("!")
                if name == tag:
                    close(i)
                    break
                if tag not in BLOCK and tag not in DROP and name in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in ("html", "body"):
            continue
        if opened["p"] and (tag in BLOCK or tag in DROP):  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK or stack[i][0].startswith("!"):
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in stops or stack[i][0].startswith("!"):
                    break
        if tag in VOID:
            if not gone:
                node.own_tags += 1
                if tag in ("br", "hr", "img"):
                    node.text.append(" ")
            continue
        if tag == "svg" and m[4].endswith("/"):  # elsewhere a slash at the end means nothing, or belongs to a value without quotes
            continue
        drop = HARD if gone else _dropped(tag, m[4], articles > 0)
        if drop == SOFT and tag not in BLOCK and tag != "a" and node.tag in RUNNING:
            drop = 0
        if drop == HARD or (drop and tag not in BLOCK):
            push("!" + tag, None)
            gone += 1
        elif tag in BLOCK:
            own = Node(tag, node, drop)
            node.kids.append(own)
            node.text.append(own)
            node = own
            articles += tag in ("article", "main")
            push(tag, own)
        else:
            node.own_tags += 1
            link = tag == "a" and "href" in m[4].lower()
            if link:
                links += 1
                node.own_link_tags += 1
            push("a" if link else "anchor" if tag == "a" else tag, None)
    if at < len(page):
        text(html.unescape(page[at:]))
    return _pruned(root)


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += n.kids[::-1]
    return out


def _density(c: float, t: float, lc: float, lt: float, share: float) -> float:
    if not c:
        return 0.0
    t, lc1, lt1, plain = max(t, 1), max(lc, 1), max(lt, 1), max(c - lc, 1)
    base = math.log(math.log(c / plain * lc + share * c + math.e))
    # a page without links has base 0: the plain ratio is left
    return c / t * (max(math.log(c / lc1 * t / lt1), 0.0) / base if base > 1e-9 else 1.0)


def measure(root: Node) -> list[Node]:
    """Densities and density sums of all nodes, in page order."""
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = n.own_chars + sum(k.chars for k in n.kids)
        n.tags = n.own_tags + sum(k.tags + 1 for k in n.kids)
        n.link_chars = n.own_link_chars + sum(k.link_chars for k in n.kids)
        n.link_tags = n.own_link_tags + sum(k.link_tags for k in n.kids)
    share = root.link_chars / max(root.chars, 1)
    for n in reversed(nodes):
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        n.sum = _density(n.own_chars, n.own_tags, n.own_link_chars, n.own_link_tags, share) + sum(k.density for k in n.kids)
    return nodes


def _linked(chars: int, link_chars: int) -> bool:
    return 2 * link_chars > chars


def main_blocks(root: Node) -> list[Node]:
    """The selected subtrees, in page order, none within another; link lists beside the main block are taken out of root."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.sum)  # ties: the one that comes first, so the outer one
    if not best.chars:
        return []
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent
    threshold = min(n.density for n in path)
    on_path = set(map(id, path))
    top = next((n for n in reversed(path) if n.tag in ("article", "main")), None)
    if top is None:
        stack = [root]
        while stack:
            n = stack.pop()
            if n is best or (id(n) not in on_path and (n.density >= threshold or not _linked(n.chars, n.link_chars))):
                continue
            if _linked(n.own_chars, n.own_link_chars):
                n.text = [x if isinstance(x, Node) else " " for x in n.text]
            stack += n.kids
        return [root]
    titled: set[int] = set()
    holds: set[int] = set()
    for n in reversed(nodes):
        if n.tag == "h1" or any(id(k) in titled for k in n.kids):
            titled.add(id(n))
        if n.tag in ("article", "main") or any(id(k) in holds for k in n.kids):
            holds.add(id(n))
    out: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n is top or n.tag in ("article", "main"):
            out.append(n)
        elif id(n) in holds:  # not whole: what stands beside the articles in it is judged by itself
            stack += n.kids[::-1]
        elif n.chars and (n.density >= threshold or (id(n) in titled and id(top) not in titled and not _linked(n.chars, n.link_chars))):
            out.append(n)
    return out


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order, white space runs as one space."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        joined = _WHITE.sub(" ", "".join(run)).strip()
        if joined:
            out.append(joined)
        run.clear()

    stack: list = [iter(node.text)]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            end()
        elif isinstance(x, Node):
            end()
            stack.append(iter(x.text))
        else:
            run.append(x)
    return out


def main_text(page: str) -> str:
    """The page's main text; empty for a page without any."""
    return "\n\n".join(b for n in main_blocks(parse(page)) for b in blocks(n))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Of nodes whose density sums tie, the first in page order is the main one.
    Null html counts as empty, and gives empty text; null ids and urls are
    kept; repeated rows give repeated rows; an empty table gives none. Other
    columns aren't read, whatever their names. The whole page is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
