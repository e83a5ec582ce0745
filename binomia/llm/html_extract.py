"""Main text by composite text density.

A lenient parser builds the tree of the whole page. What markup names as no article (navigation, headers and footers of
the page, asides, forms, scripts, and elements whose class or id says menu, sidebar, advert, notice, comments ...) is cut.
On the rest each node's density is its characters per tag, adjusted by how much of them are link text; a node's density
sum is that of its children. The node of largest sum fixes the threshold (the least density on the path from body to it),
and from the body down, wherever a node reaches the threshold, its subtree's node of largest sum is content. Content that
lies under one block is taken with all that block holds, so short paragraphs stay; if it lies in an article or main
element, or spreads over the page, all such elements side by side are content, but those that are mostly links.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
space, and nothing else is dropped. Parsing is linear; recursion is not used, so depth is no limit.

Defined results: null or empty html, or a page without content, gives an empty text; rows with null ids or urls and repeated
rows are extracted like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
CUT = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav aside footer form button select option textarea input label fieldset dialog menu title noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words of a class or id that name a part which is no article.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation sidebar aside footer header masthead breadcrumb breadcrumbs comment comments "
    "respond replies disqus notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar "
    "widget skip legal copyright disclaimer".split()
)
#: What may follow such a word in a compound that still names the part (`sidebar-left`); else its last word decides
#: (`site-footer` is a footer, `header-image` an image, `social-history` a history).
PLACES = frozenset("area bar block bottom box column container content group inner item items left link links list main outer panel primary region right row secondary section top wrap wrapper".split())
#: Compounds with these words before `header` hold an article's title.
TITLED = frozenset("article content entry page post section story".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("html body table td th caption button object template".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s\"'>/=]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(\bhidden\b)")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total", "comment")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.kids, self.cut = tag, parent, [], cut
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _names_cut(value: str, parent: Node) -> bool:
    """Whether one of the names in a class or id says that this is no article."""
    for name in value.split():
        words = _WORD.findall(name)
        while len(words) > 1 and words[-1] in PLACES:
            words.pop()
        if words and words[-1] in CUT_WORDS and not (words[-1] == "header" and (not TITLED.isdisjoint(words) or _in_article(parent))):
            return True
    return False


def _is_cut(tag: str, attributes: str, parent: Node) -> bool:
    if tag in CUT:
        return True
    if tag == "header" and not _in_article(parent):  # an article's own header holds its title
        return True
    if "=" not in attributes and "hidden" not in attributes or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attributes):
        if m[3]:
            return True
        name, value = m[1].lower(), m[2].strip("\"'").lower()
        if name in ("class", "id"):
            if tag not in ("article", "main") and _names_cut(value, parent):
                return True
            if tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(_WORD.findall(value)):
                return True
        elif name == "role" and value in CUT_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and decoded strings, cut nodes have none."""
    root = Node("#root", None)
    at, here, n = root, 0, len(page)
    dark: Node | None = None  # the cut node that we are in
    open_tags: Counter[str] = Counter()  # so that a tag that is not open costs no walk

    def text(raw: str) -> None:
        if raw and dark is None:
            at.kids.append(_html.unescape(raw) if "&" in raw else raw)

    def up(to: Node) -> None:
        """Closes all down to and with `to`."""
        nonlocal at, dark
        node = at
        while node is not to.parent:
            if node is dark:
                dark = None
            open_tags[node.tag] -= 1
            node = node.parent
        at = to.parent

    last_gt = page.rfind(">")
    while here < n:
        lt = page.find("<", here)
        if lt < 0:
            text(page[here:])
            break
        nxt = page[lt + 1 : lt + 2]
        if not (nxt.isascii() and nxt.isalpha() or nxt in ("/", "!", "?")):
            text(page[here : lt + 1])
            here = lt + 1
            continue
        text(page[here:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4 if not page.startswith("<!-->", lt) else lt + 2)
            here = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            here = n if end < 0 else end + 1
            continue
        if last_gt < lt:
            break  # an unfinished tag at the end
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if nxt == "/":  # </ without a name: a bogus comment
                end = page.find(">", lt)
                here = n if end < 0 else end + 1
                continue
            break  # an unfinished tag at the end
        here = m.end()
        tag = m[2].lower()
        if m[1]:
            if not open_tags[tag]:
                continue
            node = at
            while node is not root and node.tag != tag:
                if tag in INLINE and node.tag not in INLINE and node.tag in _SCOPE:
                    node = root
                    break
                node = node.parent
            if node is not root:
                if tag in INLINE and any_block_between(at, node):
                    continue  # misnested: </b> after a block began inside; the block goes on
                up(node)
            continue
        if tag in _CLOSES_P:
            node = at
            while open_tags["p"] and node is not root and node.tag != "p" and node.tag not in _SCOPE:
                node = node.parent
            if node.tag == "p":
                up(node)
            if tag in _HEADINGS and at.tag in _HEADINGS:
                up(at)
        elif tag in _SAME and any(open_tags[x] for x in _SAME[tag]):
            node = at
            while node is not root and node.tag not in _SAME[tag] and node.tag not in _HOLDS[tag]:
                node = node.parent
            if node.tag in _SAME[tag]:
                up(node)
                if tag == "tr" and at.tag == "tr":
                    up(at)
        node = Node(tag, at, dark is not None or _is_cut(tag, m[3], at))
        at.kids.append(node)
        closed = tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "use")
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, here)
            if tag in RAW or node.cut:
                here = n if end is None else end.start()
            if end is None:
                break
        if not closed:
            at = node
            open_tags[tag] += 1
            if node.cut and dark is None:
                dark = node
    return root


def any_block_between(low: Node, high: Node) -> bool:
    while low is not high:
        if low.tag not in INLINE:
            return True
        low = low.parent
    return False


def _walk(root: Node) -> list[Node]:
    """The nodes that are not cut, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.cut:
            continue
        out.append(node)
        stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def _measure(nodes: list[Node], body: Node) -> None:
    for node in reversed(nodes):
        link = node.tag == "a"
        for k in node.kids:
            if isinstance(k, str):
                size = len(_SPACE.sub(" ", k).strip())
                node.chars += size
                node.link_chars += size * link
            elif not k.cut:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.chars if link else k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            continue
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
        node.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / base if node.link_chars else c / t * max(1.0, math.log(max(math.e, c * t))) / max(1.0, base)
    for node in nodes:
        node.total = sum(k.density for k in node.kids if not isinstance(k, str) and not k.cut)


def _content(root: Node) -> list[Node]:
    """The block that holds the content, or the articles side by side that do."""
    nodes = _walk(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    inside = _walk(body)
    _measure(inside, body)
    if not body.chars:
        return []
    best = max(inside, key=lambda x: x.total)
    if not best.total:
        return [body]  # text without any tag below
    least, at = best.density, best
    while at is not body:
        at = at.parent
        least = min(least, at.density)
    # From the body down: the node of largest sum under each node that reaches the threshold.
    top: dict[int, Node] = {}
    for x in reversed(inside):
        top[id(x)] = max([x, *(top[id(k)] for k in x.kids if not isinstance(k, str) and not k.cut)], key=lambda y: y.total)
    marked, stack = [], [body]
    while stack:
        x = stack.pop()
        if x.density < least or not x.chars:
            continue
        m = top[id(x)]
        if x is not body and m.total >= 0.5 * best.total or m is best:
            marked.append(m)
        elif m.total >= 0.1 * best.total:
            stack += [k for k in x.kids if not isinstance(k, str) and not k.cut]
        if x is body:
            stack += [k for k in x.kids if not isinstance(k, str) and not k.cut]
    marked = list({id(m): m for m in marked or [best]}.values())

    def path(x: Node) -> list[Node]:
        out = [x]
        while out[-1] is not body:
            out.append(out[-1].parent)
        return out[::-1]

    paths = [path(m) for m in marked]
    common = body
    for level in zip(*paths, strict=False):
        if any(x is not level[0] for x in level):
            break
        common = level[0]
    if common.tag in INLINE or common.tag in ("p", *_HEADINGS):
        while common is not body and (common.tag in INLINE or common.tag in ("p", *_HEADINGS)):
            common = common.parent
    named = any(x.tag in ("article", "main") for x in path(common))
    if named or common is body:
        # The choice lies in what an author marks as an article, or spreads over the page: all that is marked so, outermost.
        articles, stack = [], [body]
        while stack:
            x = stack.pop()
            if x.tag in ("article", "main"):
                if x.chars and not (_is_menu(x) and x is not common):
                    articles.append(x)
            else:
                stack += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.cut]
        return articles or [common]
    # sections side by side make one article: go up while what the parent adds is text of like density
    while common.parent is not body and common.parent is not None and common.parent.density >= least and common.parent.chars - common.chars < common.chars:
        common = common.parent
    return [common]


def _is_menu(x: Node) -> bool:
    """A block that is mostly links, two or more."""
    return x.tag not in INLINE and x.tag != "p" and x.link_tags > 1 and x.link_chars > 0.5 * x.chars


def extract(page: str) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes = _content(parse(page))
    if not nodes:
        return ""
    blocks, run = [], []
    named = nodes[0].tag in ("article", "main")  # what an author marks as the article is taken whole
    stack: list[Node | str | None] = []  # None ends a block
    for node in reversed(nodes):
        stack += [None, *reversed(node.kids)]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append("".join(run))
            run = []
        elif isinstance(x, str):
            run.append(x)
        elif x.cut or not named and _is_menu(x):
            stack.append(None) if x.tag not in INLINE else None
        elif x.tag in INLINE:
            stack += reversed(x.kids)
        else:
            stack.append(None)
            stack += reversed(x.kids)
            stack.append(None)
    blocks.append("".join(run))
    return " ".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [extract(x or "") for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
