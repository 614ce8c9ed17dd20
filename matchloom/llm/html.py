"""Main text of web pages by composite text density.

Every DOM node gets a density: characters per tag, adjusted by how much of its text stands in links compared with the
whole body. A node's density sum adds the densities of its children, texts among them; the subtree with the largest sum
is the heart of the page. The smallest density on the path from the body to it is the threshold. From the heart to the
body, a node beside the path belongs to the article if it is at least that dense; paragraphs, headings, lists and tables
beside a paragraph of the path belong to it however short they are. Under the threshold, lists of links and boxes with
names such as widget or share go wherever they stand, and so do other article elements than the path's.

Tags, roles and names only cut out what an article's text never holds (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, comments); they choose nothing. What is cut out counts for the body's density.

A null or empty page, and one without text outside such parts, gives an empty text. Repeated rows are extracted each.
Text is cut into blocks at block elements; white space within a block becomes one space.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read

#: Element lists of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|noframes|xmp"
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Never part of the article.
CUT = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input label link map "
    "menu meta nav noscript object option script select style svg template textarea title video".split()
)
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names that mark what surrounds an article.
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist cookie "
    "cookies consent discussion disqus feedback footer gdpr masthead menu modal nav navbar navigation newsletter notice popup promo "
    "promoted recommended related replies reply responses sidebar signup sponsor sponsored subscribe teaser teasers toolbar".split()
)
#: Those that mark it only where the text is thin.
THIN_NAMES = frozenset("disclaimer share sharing social tags widget widgets".split())
#: A name with one of these words tells how a page is laid out: with-sidebar, comments-open.
LAYOUT = frozenset("closed disabled enabled has layout no open with without".split())
#: What stands in running text; other block elements hold such parts.
PROSE = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td tfoot th thead tr ul".split())

#: What follows a tag's name: quotes count only after an equals sign, and a tag that never ends runs to the page's end.
#: Nothing is read twice, so that broken markup costs no more than its length.
ATTRS = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[\"'=])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){ATTRS}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({ATTRS})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s/=>\"']++)(?:\s*+=\s*+(\"[^\"]*+|'[^']*+|[^\s>]*+))?")
NAME = re.compile(r"[a-z]+")
#: Open elements that a start tag closes first.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody"),
}
STOPS = frozenset("ul ol dl table article section div main body html nav aside header footer form select".split())


class Node:
    __slots__ = ("blocks", "chars", "children", "cut", "density", "link_chars", "link_tags", "marked", "p", "parent", "tag", "tags", "thin", "total")

    def __init__(self, tag: str, parent: "Node | None", cut: bool = False, thin: bool = False):
        self.tag, self.parent, self.cut, self.thin = tag, parent, cut, thin
        #: Whether a block element is inside.
        self.blocks = False
        #: Whether it is inside an article or main element; the paragraph that a block in it closes.
        self.marked: bool = tag in ("article", "main") or parent is not None and parent.marked
        self.p: Node | None = self if tag == "p" else parent.p if parent is not None and tag not in STOPS else None
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def told(tag: str, attributes: str, parent: Node) -> tuple[bool, bool]:
    """Whether tag, role and names cut an element out, and whether its names would if it is thin."""
    if tag in CUT or tag == "header" and not parent.marked:
        # A header inside the article holds its title.
        return True, False
    if not attributes or tag in ("html", "body", "article", "main") and "hidden" not in attributes.lower() and "class" not in attributes.lower():
        return False, False
    thin = False
    for key, value in ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in CUT_ROLES:
            return tag not in ("html", "body"), False
        if key in ("class", "id") and tag not in ("html", "body"):
            for name in value.split():
                words = NAME.findall(name)
                if LAYOUT.isdisjoint(words):
                    if not CUT_NAMES.isdisjoint(words) or {"side", "bar"}.issubset(words) or words[-1:] == ["header"] and words[0] in ("header", "page", "site", "top") and not parent.marked:
                        return True, False
                    thin = thin or not THIN_NAMES.isdisjoint(words)
    return False, thin


def parse(page: str) -> Node:
    """The tree of a page: unclosed and misnested tags are mended much as a browser does."""
    root = node = Node("#root", None)
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            up = node
            while up is not root and up.tag != tag:
                # An inline end tag does not close a block.
                if up.tag in BLOCK and tag not in BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in BLOCK:
            node = node.p.parent if node.p else node
        if tag in CLOSES:
            up = node
            while up is not root and up.tag not in CLOSES[tag] and up.tag not in STOPS:
                up = up.parent
            if up.tag in CLOSES[tag]:
                node = up.parent
        attributes = m[4] or ""
        child = Node(tag, node, *told(tag, attributes, node))
        node.children.append(child)
        if tag not in VOID and not attributes.endswith("/"):
            node = child
    if at < len(page):
        node.children.append(page[at:])
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """The composite text density of a node; counts of 0 count as 1. share: of the body's characters, those in links."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * links + share * chars + math.e)
    return chars / tags * math.log(chars / links * tags / link_tags) / math.log(base)


def measure(body: Node) -> None:
    """Counts, densities and density sums of all nodes."""
    nodes = walk(body)
    every_char = every_link = 0
    in_link = {id(body): False}
    sizes = {}
    for n in nodes:
        link = in_link[id(n)] = n is not body and (in_link[id(n.parent)] or n.tag == "a")
        sizes[id(n)] = own = [len("".join(c.split())) if isinstance(c, str) else 0 for c in n.children]
        n.chars = sum(own)
        n.link_chars = n.chars * link
        every_char += n.chars
        every_link += n.link_chars
    share = every_link / max(every_char, 1)
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.link_chars += c.link_chars
                n.tags += c.tags + 1
                n.link_tags += c.link_tags + (c.tag == "a")
                n.blocks = n.blocks or c.blocks or c.tag in BLOCK
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        n.total = sum(
            (c.density if not c.cut else 0.0) if isinstance(c, Node) else density(size, 1, size * in_link[id(n)], 0, share)
            for c, size in zip(n.children, sizes[id(n)])
        )


def prose(n: Node) -> bool:
    """Whether it stands in running text: a paragraph, heading, list or table, or anything without block elements inside."""
    return n.tag in PROSE or not n.blocks


def select(body: Node) -> tuple[set[int], list[Node], float]:
    """The ids of the nodes whose text is the article, the path to the largest density sum, and the threshold."""
    nodes, todo = [], [body]
    while todo:
        n = todo.pop()
        if n.chars:
            nodes.append(n)
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.cut)
    if not nodes:
        return set(), [], 0.0
    path = [max(nodes, key=lambda n: n.total)]
    while path[-1] is not body:
        path.append(path[-1].parent)
    limit = min(n.density for n in path)
    kept = {id(path[0])}
    for below, n in zip(path, path[1:]):
        run = prose(below)
        kept |= {id(c) for c in n.children if isinstance(c, Node) and not c.cut and (run and prose(c) or c.density >= limit)}
    return kept, path, limit


def blocks(body: Node, kept: set[int], path: list[Node], limit: float) -> list[str]:
    """The texts of the blocks inside kept nodes, and the bare texts beside prose on the path."""
    out, line = [], []
    on_path = {id(n) for n in path}
    bare = {id(n) for below, n in zip(path, path[1:]) if prose(below)}
    in_article = any(n.tag == "article" for n in path)

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split()) if line else ""
        if text:
            out.append(text)
        line.clear()

    def dropped(n: Node) -> bool:
        if n.cut or id(n) in on_path:
            return n.cut
        if n.tag == "article" and in_article:
            return True
        links = n.blocks and n.link_tags >= 3 and 10 * n.link_chars >= 7 * n.chars
        return n.density < limit and (n.thin or links or n.tag == "article")

    # (node, whether it is inside the article, whether it is being left)
    todo: list[tuple[Node | str, bool, bool]] = [(body, False, False)]
    while todo:
        n, inside, leaving = todo.pop()
        if isinstance(n, str):
            if inside:
                line.append(n)
            continue
        if leaving:
            end()
            continue
        if dropped(n):
            continue
        inside = inside or id(n) in kept
        if n.tag in BLOCK:
            end()
            todo.append((n, inside, True))
        elif n.tag in ("br", "td", "th"):
            line.append(" ")
        todo.extend((c, inside or isinstance(c, str) and id(n) in bare, False) for c in reversed(n.children))
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    body = next((n for n in walk(root) if n.tag == "body"), root)
    measure(body)
    return "\n\n".join(blocks(body, *select(body)))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): its main text and that text's length in code points."""

    def make():
        def apply(batch):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

        return apply

    return map_batches(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
