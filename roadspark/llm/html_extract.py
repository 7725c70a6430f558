"""Main text of HTML pages by tree scoring.

A page becomes a tree, in time linear in its length: tags that close others by implication, raw-text elements,
unclosed and stray tags, and quotes are read as browsers do (an attribute's unclosed quote runs to the next
quote, and a tag that never ends is dropped). Elements that are never content by tag, role or name go first:
menus, headers of the site, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.
Names are judged part by part: in a container's name one structural part is enough, whatever else stands in it
(`main-menu`, `post-comments`), while a text-level element goes only by a name made of such parts alone.

Each paragraph-like block then passes points to its ancestors, for its length and its commas, halved at each
level; a container's points are discounted by the share of its text that stands in links. Where the best
container lies in an article or main, all of that is kept but lists of links beside the container, with articles
beside it; elsewhere the best container is, with siblings that score near it or read like prose. All text of
what is kept comes out block by block.

Null or empty html, or a page without content, gives the empty string. Whole pages are read; nothing is
capped. Of containers with equal points the first in page order is the best. Repeated rows come out each for
itself; columns beside the three named are left out, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe head nav footer aside form button select option textarea object embed svg canvas audio video menu dialog label input fieldset map math applet".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr html body li dd dt".split()) | {"p"}
#: Containers that may be lists of links.
LISTS = frozenset("div section ul ol dl table".split())
#: A start tag closes these, up to the scopes named after them.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
#: Text-level elements, which a name drops only if all its parts are structural.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 span a b i em strong small u code pre q cite blockquote figure figcaption td th tr tbody table caption dd dt time mark sub sup abbr address".split())
#: Parts of names of what is no content wherever they stand.
STRONG = re.compile(
    r"ads?|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|sidebars?|\w+sidebar|navs?|navbar|\w+nav|navigation|menus?|menubar|\w+menu|breadcrumbs?|foot|footers?|\w+footer|masthead|topbar|"
    r"cookies?|\w*cookie|consent|gdpr|popups?|modal|newsletters?|comments?|commentlist|\w+comments|commentform|respond|replies|disqus|pager|pagination|toolbar|tagcloud|related\w*|recommend\w*",
    re.I,
)
#: Parts that say so in class names and in ids but for those of sections, which may be anchors.
WEAK = re.compile(r"banner\w*|side|widgets?|notices?|alerts?|overlay|subscri\w*|signup|signin|login|share|sharing|sharebar|social\w*|skip|skiplink|legal|copyright|tags|cloud|rss|search|searchform|form|disclaimer", re.I)
#: A name with one of these tells about layout, one that begins with one of those about a post's kind.
LAYOUT = frozenset("has no with without layout".split())
KINDS = frozenset("category tag type status format lang is wp js".split())
HEADERS = frozenset("header head headerbar".split())
LIKELY = re.compile(r"article\w*|content|main|post|entry|story|text|body|hentry", re.I)
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])|[^\W_a-zA-Z0-9]+")
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=(?!\s*+[\"']))*+)(>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "score", "size", "links", "commas")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.kids, self.parent, self.score = tag, attrs, [], parent, 0.0
        self.size = self.links = self.commas = 0


class Tree:
    """The tree under construction: the open elements, and where on their stack each tag and each block stands."""

    def __init__(self):
        self.root = Node("html", {}, None)
        self.stack, self.places, self.blocks = [self.root], {}, []

    def open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Closes all from place `at` on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The innermost place of any of the tags; 0 where none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def implied(self, tag: str) -> None:
        """Closes what a start tag ends."""
        if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in IMPLIED:
            shut, scope = IMPLIED[tag]
            outer = self.last(scope)
            while (at := self.last(shut)) > outer:
                self.close(at)


def parse(html: str) -> Node:
    """The page's tree; texts are strings among the children, with references decoded."""
    tree = Tree()
    at, n = 0, len(html)
    ends: dict[str, int] = {}
    while at < n:
        kids = tree.stack[-1].kids
        lt = html.find("<", at)
        if lt < 0:
            kids.append(unescape(html[at:]))
            break
        if lt > at:
            kids.append(unescape(html[at:lt]))
        m = TOKEN.match(html, lt)
        if m is None:  # an angle bracket that opens nothing
            kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.group(2) is None or not m.group(4):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if place := tree.last((tag,)):
                if tag != "p" or tree.blocks and tree.blocks[-1] == place:
                    tree.close(place)
            continue
        if tag == "html":
            continue
        tree.implied(tag)
        attrs = {}
        for name, x, y, z in ATTR.findall(m.group(3)):
            attrs.setdefault(name.lower(), unescape(x or y or z))
        node = Node(tag, attrs, tree.stack[-1])
        node.parent.kids.append(node)
        if tag in RAW:
            found = ends.get(tag, 0)
            if 0 <= found < at:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                found = ends[tag] = close.start() if close else -1
            if found < 0 and m.group(3).endswith("/"):  # XHTML's empty element
                continue
            if found < 0:
                found = n
            node.kids.append(html[at:found])
            gt = html.find(">", found)
            at = gt + 1 if gt >= 0 else n
        elif tag not in VOID:
            tree.open(node)
    return tree.root


def structural(node: Node, within: bool) -> bool:
    """Whether an element's names are those of a menu, header, footer, sidebar, notice, advert, form or comments."""
    textual, a = node.tag in TEXTUAL or node.tag == "article", node.attrs
    for source in ("class", "id"):
        for name in a.get(source, "").split():
            parts = [x.lower() for x in PARTS.findall(name)]
            if not parts or LAYOUT.intersection(parts) or parts[0] in KINDS and parts != ["tag", "cloud"]:
                continue
            weak = source == "class" or node.tag != "section"
            marks = [bool(STRONG.fullmatch(x) or weak and WEAK.fullmatch(x)) for x in parts]
            if node.tag == "article" and marks[0] and STRONG.fullmatch(parts[0]) and all(m or LIKELY.fullmatch(x) or x in ("item", "list") for m, x in zip(marks, parts)):
                return True
            if all(marks) if textual else any(marks):
                return True
            if not within and not textual and HEADERS.intersection(parts) and not any(LIKELY.fullmatch(x) and x != "main" or x == "section" for x in parts):
                return True
    return False


def unlikely(node: Node, within: bool) -> bool:
    """Whether an element is no content by its tag, role or names; within: in an article or main."""
    if node.tag in DROPPED or node.tag == "header" and not within:
        return True
    a = node.attrs
    if not a or node.tag in ("body", "main"):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    return ("class" in a or "id" in a) and structural(node, within)


def prune(root: Node) -> None:
    """Removes what is no content; a header goes unless it stands in an article or main."""
    stack = [(root, False)]
    while stack:
        node, within = stack.pop()
        keep = []
        for k in node.kids:
            if isinstance(k, Node):
                inside = within or k.tag in ("article", "main")
                if unlikely(k, inside):
                    continue
                stack.append((k, inside))
            keep.append(k)
        node.kids = keep


def _order(root: Node) -> list[Node]:
    """Parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def score(root: Node) -> Node | None:
    """The container with the most points; None where there is no text."""
    nodes = _order(root)
    for node in reversed(nodes):
        for k in node.kids:
            if isinstance(k, Node):
                node.size, node.links, node.commas = node.size + k.size, node.links + k.links, node.commas + k.commas
            else:
                n = len(k.strip())
                node.size, node.commas = node.size + n, node.commas + k.count(",")
        if node.tag == "a":
            node.links = node.size
    best, most = None, 0.0
    for node in nodes:
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        para = node.tag in ("p", "pre", "td", "blockquote", "li", "dd") or own >= 25 and node.tag in ("div", "section", "article", "body", "html", "main")
        if para and node.size:
            points = (1 + node.commas + min(3.0, node.size / 100)) * (1 - node.links / node.size)
            up, share = (node if node.tag in ("div", "section", "article", "main", "body", "html") else node.parent), 1.0
            while up is not None and share > 0.05:
                up.score += points * share
                up, share = up.parent, share / 2
    for node in nodes:
        if not node.size or node.tag in ("p", "a", "b", "i", "em", "strong", "span", "li", "td", "tr", "h1", "h2", "h3"):
            continue
        value = (node.score + (25 if node.tag in ("article", "main") else 5 if any(LIKELY.fullmatch(x) for x in PARTS.findall(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")) else 0)) * (1 - node.links / node.size)
        if node.score > 0 and value > most:
            best, most = node, value
    if best is None and root.size:
        best = max((x for x in nodes if x.tag in ("article", "main", "body", "div", "html") and x.size), key=lambda x: (x.tag in ("article", "main"), x.size * (1 - x.links / x.size)), default=root)
    return best


def widened(best: Node) -> Node:
    """The nearest article around the best container, else the nearest main, else the container; what is link-heavy beside the container goes."""
    around, node = [], best
    while node is not None:
        around.append(node)
        node = node.parent
    top = next((x for tag in ("article", "main") for x in around if x.tag == tag), best)
    inner = best
    while inner is not top:
        up = inner.parent
        up.kids = [k for k in up.kids if k is inner or not isinstance(k, Node) or k.tag not in LISTS or 2 * k.links <= k.size]
        inner = up
    return top


def kept(best: Node) -> list[Node]:
    """The best container and, in page order, what belongs to it: articles beside an article, headings before it in a main; beside other containers those that score near it or read like prose."""
    if best.parent is None or best.tag in ("main", "body"):
        return [best]
    limit, out, before = max(10.0, best.score * 0.2), [], True
    for k in best.parent.kids:
        if not isinstance(k, Node):
            continue
        density = k.links / k.size if k.size else 1.0
        heading = k.tag in ("h1", "h2") and k.size and density < 0.5
        before = before and k is not best
        if best.tag == "article":
            take = k.tag == "article" and density < 0.5 or heading and before and best.parent.tag == "main"
        else:
            prose = k.tag == "p" and (k.size > 80 and density < 0.25 or 0 < k.size <= 80 and density == 0 and k.commas + 1 > 1)
            take = k.score * (1 - density) >= limit or prose or heading
        if k is best or take:
            out.append(k)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks in page order, without empty ones."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                end()
                stack.append(None)
                stack.extend(reversed(x.kids))
            else:
                stack.extend(reversed(x.kids))
        end()
    return out


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    best = score(root)
    return "\n".join(blocks(kept(widened(best)))) if best is not None else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of every page."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = pa.array([extract(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
