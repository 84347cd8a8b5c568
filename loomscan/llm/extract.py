"""Main text of web pages by composite text density.

For every DOM node: characters for each tag, adjusted for link characters and link tags (composite text density), and
the sum of its child blocks' densities (elements inside a line of text only count as tags). The least density on the path from the body to the node of the greatest sum is
the threshold; of every block at or over it the subtree of the greatest sum is marked, and the main text is all that
is marked, in page order. A mark in an article (or else in main) stands for all of it, and headings right before marked
parts belong to them: their density is low whatever they head. Parts that are furniture
by element or by their class, id or role (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) are left out of the tree's text. In an article or main, names only make some parts doubtful: ids of
headings, sections and paragraphs are topics, so is a name that joins a mark to a word of its own (`related-work`), alerts
and notices among the paragraphs are text, and so are asides and content for readers without scripts. A doubtful part is
furniture only if most of its characters are links. Formulas and drawings keep their text.

Results: null, empty and textless pages give ""; unclosed and stray tags are tolerated; equal sums go to the node that
comes first; repeated rows are answered alike; extra columns are passed through, one named as an output (`main_text`)
is replaced. Work and memory are linear in a page's length.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from loomscan.llm.common import add_columns

#: A comment, a declaration, or a tag; a quote opens a value only after an equals sign.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements without content, with raw content that no reader sees, that start a block, and that are furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I) for name in "script style textarea title template iframe".split()}
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav header footer aside form button select menu dialog head noscript".split())
#: Of these, what may be part of an article's text if it lies in one: only its links can tell.
INSIDE = frozenset("header aside noscript".split())
#: Words of class, id and role names that mark furniture.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal cookie cookies consent notice notices alert newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments discussion disqus reply replies respond complementary contentinfo".split())
#: Words and names that say that something else has such a part.
HAVING = frozenset("has with without".split())
LACKING = frozenset("no-sidebar nosidebar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose ids are topics inside an article, and marks that paragraphs there may have.
TOPICS = HEADINGS | {"section", "p"}
CALLOUTS = frozenset("alert notice notices".split())
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words for the boxes that furniture comes in. A mark that is joined to any other word in a name may name a
#: topic (`related-work`, `sharing-data`).
BOXES = frozenset(
    "a area article articles bar block body bottom box btn button buttons by card cards col column container content count desktop div entries entry feed foot footer form frame global "
    "grid group head heading holder icon icons id inline inner item items js label layer layout left link links list main message mobile module modules more news page panel parent "
    "policy pop post posts primary region right root row section side site slot small space spot static sticky stories story text thread title tool tools top unit up user view views wrap wrapper zone".split()
)
#: A form around one of these is a page's wrapper, no form of the page.
MAIN = re.compile("<(?:article|main|h1)[\\s>]", re.I)
FORM_END = re.compile("</form", re.I)
#: An unquoted value that ends in a slash closes no element.
VALUE = re.compile(r"=\s*[^\s\"']*/$")
#: Elements that an opening tag of the key closes, up to the nearest of the last set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}} | {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
SCOPE = frozenset("html body article section div table ul ol dl td th main aside nav header footer form blockquote".split())


def names_furniture(element: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether a class, id or role names furniture, and whether one names what is a topic or a callout of an article
    but may be furniture; inside an article its own header is none."""
    found = [(kind.lower(), name, {w.lower() for w in WORDS.findall(name)}) for kind, value in NAMED.findall(attributes) for name in value.strip("\"'").split()]
    topic = inside and (element in TOPICS or any(kind == "class" and name.lower() == "section" for kind, name, _ in found))
    doubtful = False
    for kind, name, words in found:
        if inside and kind != "role" and words & MARKS and words - MARKS - BOXES and not words & HAVING:
            doubtful = True
        elif not words & HAVING and name.lower() not in LACKING and (marks := MARKS & (words - {"header"} if inside else words)):
            if not (topic and (kind == "id" or element == "p" and marks <= CALLOUTS)):
                return True, False
            doubtful = True
    return False, doubtful


class Node:
    __slots__ = ("chars", "density", "doubtful", "end", "frame", "furniture", "link", "links", "link_tags", "name", "parent", "start", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, furniture: bool, start: int):
        self.name, self.parent, self.furniture, self.start, self.end = name, parent, furniture, start, start
        self.chars = self.links = self.link_tags = self.tags = 0
        self.density = self.sum = 0.0
        self.doubtful = self.link = False
        above = parent.frame if parent else None
        #: The outermost article around, or else the outermost main.
        self.frame = self if name == "article" and not (above and above.name == "article") or name == "main" and not above else above


def parse(page: str) -> tuple[list[Node], list[str | None]]:
    """Nodes in page order, and the page's pieces of text (None: a block ends); a node spans pieces start to end."""
    root = Node("#", None, False, 0)
    nodes, pieces, open_ = [root], [], [root]
    at, n, links = 0, len(page), 0
    ahead = {MAIN: -1, FORM_END: -1}

    def next_(pattern: re.Pattern) -> int:
        """Place of the pattern's next match; searched anew only when passed, so all searches together are one pass."""
        if ahead[pattern] < at:
            m = pattern.search(page, at)
            ahead[pattern] = m.start() if m else n
        return ahead[pattern]

    def text(raw: str) -> None:
        top = open_[-1]
        if raw and not top.furniture:
            raw = html.unescape(raw)
            pieces.append(raw)
            top.chars += (k := len("".join(raw.split())))
            if links:
                top.links += k

    def close(count: int) -> None:
        nonlocal links
        for _ in range(count):
            node = open_.pop()
            node.end = len(pieces)
            links -= node.link

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCK:
            pieces.append(None)
        if m[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    close(len(open_) - i)
                    break
                if open_[i].name in SCOPE and name not in SCOPE:
                    break
            continue
        if name in CLOSES:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name in CLOSES[name]:
                    close(len(open_) - i)
                    break
                if open_[i].name in SCOPE:
                    break
        if name in RAW:
            end = RAW[name].search(page, at)
            at = (page.find(">", end.start()) + 1 or n) if end else n
            open_[-1].tags += 1
            continue
        if name in VOID:
            open_[-1].tags += 1
            continue
        parent = open_[-1]
        marked = parent.furniture or name in FURNITURE and not (name in INSIDE and parent.frame) and not (name == "form" and next_(MAIN) < next_(FORM_END))
        doubtful = not marked and name in ("aside", "noscript")
        if not marked and name not in ("html", "body", "article"):
            marked, named = names_furniture(name, m[3] or "", parent.frame is not None)
            doubtful = doubtful or named
        marked = marked and name != "main"  # whatever its wrappers are called
        node = Node(name, parent, marked, len(pieces))
        node.doubtful = doubtful
        nodes.append(node)
        if name in BLOCK or not m[3].endswith("/") or VALUE.search(m[3]):
            open_.append(node)
            node.link = name == "a" and "href" in (m[3] or "").lower()
            links += node.link
    close(len(open_))
    if any(x.doubtful for x in nodes):
        drop_link_lists(nodes, pieces)
    return nodes, pieces


def drop_link_lists(nodes: list[Node], pieces: list[str | None]) -> None:
    """Doubtful parts that are mostly links become furniture."""
    chars, links = {x: x.chars for x in nodes}, {x: x.links for x in nodes}
    for node in reversed(nodes):
        if node.parent and not node.furniture:
            chars[node.parent] += chars[node]
            links[node.parent] += links[node]
    dropped: set[Node] = set()
    for node in nodes:
        if node.parent in dropped:
            node.furniture = True
            dropped.add(node)
        elif node.doubtful and 2 * links[node] > chars[node]:
            node.furniture = True
            dropped.add(node)
            pieces[node.start : node.end] = [None] * (node.end - node.start)


def densities(nodes: list[Node]) -> None:
    """Subtree counts, composite densities and density sums, children before parents."""
    for node in reversed(nodes):
        node.tags += 1
        if (up := node.parent) and not node.furniture:
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags
            up.link_tags += node.link_tags + (node.name == "a")
    body = next((x for x in nodes if x.name == "body"), nodes[0])
    share = body.links / body.chars if body.chars else 0.0
    for node in nodes:
        if node.chars and not node.furniture:
            c, lc, t, lt = node.chars, max(node.links, 1), node.tags, max(node.link_tags, 1)
            base = math.log(c / max(c - node.links, 1) * node.links + share * c + math.e)
            node.density = max(0.0, c / t * math.log(max(c / lc * t / lt, 1e-9)) / math.log(base)) if base > 1 else c / t
            if node.name in BLOCK:  # text-level elements count as tags; sums are of blocks
                up = node.parent
                while up and up.name not in BLOCK and up.parent:
                    up = up.parent
                up.sum += node.density


def marked(live: list[Node], best: Node) -> list[Node]:
    """Nodes whose subtrees are the main text, in page order, none in another."""
    if not best.sum:  # text without elements
        best = max(live, key=lambda x: x.density)
        while best.parent and best.name not in BLOCK:
            best = best.parent
        return [best.frame or best]
    threshold, up = best.density, best
    while up.parent and up.name != "body":
        up = up.parent
        threshold = min(threshold, up.density)
    top = {x: x for x in live}  # of each subtree the node of the greatest sum, the first of equals
    for node in reversed(live):
        if node.parent in top and top[node].sum >= top[node.parent].sum and top[node].sum > node.parent.sum:
            top[node.parent] = top[node]
    # nodes come before those in them, so what is marked further down is known when it is reached
    picked: set[Node] = set()
    covered: set[Node] = set()
    for node in live:
        if node.parent in covered or node in picked:
            covered.add(node)
        elif node.density >= threshold and (node.name in BLOCK or not node.parent):
            picked.add(top[node].frame or top[node])
            if node in picked:
                covered.add(node)
    holding, follows = set(picked), {}
    for node in reversed(live):  # the next block after each heading
        if node.name in BLOCK:
            if node.name in HEADINGS and follows.get(node.parent):
                picked.add(node)
                holding.add(node)
            follows[node.parent] = node in holding
        if node in holding and node.parent:
            holding.add(node.parent)
    out, covered = [], set()
    for node in live:
        if node.parent in covered:
            covered.add(node)
        elif node in picked:
            covered.add(node)
            out.append(node)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, pieces = parse(page)
    densities(nodes)
    live = [x for x in nodes if x.chars and not x.furniture]
    if not live:
        return ""
    best = max(live, key=lambda x: x.sum)
    blocks, held = [], []
    for node in marked(live, best):
        for piece in [*pieces[node.start : node.end], None]:
            if piece is not None:
                held.append(piece)
            elif held:
                if block := " ".join("".join(held).split()):
                    blocks.append(block)
                held = []
    return "\n".join(blocks)


def extract(df: DataFrame, column: str = "html", name: str = "main_text") -> DataFrame:
    """df with the main text of each page."""
    return add_columns(df, column, [(name, "string")], lambda: lambda pages: [[main_text(p) for p in pages.to_pylist()]], rows=64)
