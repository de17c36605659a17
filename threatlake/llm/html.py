"""Main text of web pages by composite text density.

Every DOM node gets a link-adjusted count of characters per tag; a node's density sum adds
those of its children. The node with the greatest sum, held against the least density on
its path to the body, is the article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg annotation annotation-xml".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th "
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split()
)
#: Markup inside a block: part of its text, no summand of a density sum.
_PHRASE = _INLINE - {"td", "th"}
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("article aside body blockquote button caption div dl footer form header li main nav ol section table td th ul".split())
#: Not the article: elements, roles, and words in class and id.
_OUT_TAGS = frozenset("nav footer aside form button select dialog menu object embed canvas audio video head".split()) | _RAW
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus respond replies reply widget toolbar pager pagination skip paywall".split()
)
#: Words beside those in a compound name that say where or what a box is, not what it is about.
_BOX_WORDS = frozenset(
    "site page main top bottom left right header head inner outer box bar row block area section container wrapper wrap holder panel pane list item items link links text title "
    "button buttons btn icon icons img image form input slot unit zone content body group primary secondary global mobile desktop sticky fixed posts post articles stories".split()
)
#: Elements of a form that ask for something, and text characters for each of them from which a
#: form is read as text that happens to stand in a form.
_CONTROLS = frozenset("input button select textarea".split())
_FORM_CHARS = 200
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*+)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_STOP = re.compile(r"[>\"']")
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
#: The least divisor of a density: pages without links, where the formula's logarithm is 0, stay comparable.
_LEAST_SCALE = 0.1


class Node:
    __slots__ = ("tag", "parent", "kids", "out", "header", "chars", "tags", "link_chars", "link_tags", "density", "total", "named")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.out = self.header = self.named = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _out_name(name: str) -> bool:
    """Whether a whole class or id names what is no article: each of its words does, or says only
    what box it is ("site-footer", "cookieNotice"; not "no-sidebar" or "related-work")."""
    words = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))]
    return any(w in _OUT_WORDS for w in words) and all(w in _OUT_WORDS or w in _BOX_WORDS for w in words)


def _marks(node: Node, attrs: str) -> None:
    """Sets out (not of the article) and header from tag and attributes."""
    node.out, node.header = node.tag in _OUT_TAGS, node.tag == "header"
    if not attrs or node.tag in ("html", "body"):
        return
    found = {m[1].lower(): next((g for g in (m[2], m[3], m[4]) if g is not None), "") for m in _ATTR.finditer(attrs)}
    names = [w for k in ("class", "id") if k in found for w in found[k].split()]
    node.named = any(map(_out_name, names)) or found.get("role", "").lower() in _OUT_ROLES
    node.named |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    node.out |= node.named
    node.header |= any(n.lower() in ("header", "site-header", "page-header", "main-header", "top-header") for n in names)


def _decoded(text: str) -> str:
    """Character references as characters; numbers beyond Unicode as U+FFFD."""
    return unescape(_HUGE.sub("�", text))


def _tag_end(html: str, at: int, lost: set[str]) -> int:
    """Where the tag that is open at `at` ends: at the next > outside quoted values, -1 if none.

    A quote counts after an equals sign; one that is never closed is an ordinary character.
    Each character is looked at once, as the search never goes back (lost: quotes that do not
    occur any more).
    """
    while m := _STOP.search(html, at):
        at, mark = m.end(), m[0]
        if mark == ">":
            return at
        before = m.start() - 1
        while html[before].isspace():
            before -= 1
        if html[before] == "=" and mark not in lost:
            close = html.find(mark, at)
            if close < 0:
                lost.add(mark)
            else:
                at = close + 1
    return -1


class _Open:
    """The open elements. Per fence the number of open elements of each tag above it, so that
    every question about them takes one look."""

    def __init__(self, root: Node):
        self.stack, self.scopes, self.names, self.fences = [root], [Counter()], [""], Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        if node.tag in _FENCE:
            self.fences[node.tag] += 1
            self.scopes.append(Counter())
            self.names.append(node.tag)
        else:
            self.scopes[-1][node.tag] += 1

    def pop_to(self, tags: set[str]) -> None:
        """Closes elements up to the nearest of `tags`, which is open."""
        done = False
        while not done:
            node = self.stack.pop()
            done = node.tag in tags
            if node.tag in _FENCE:
                self.fences[node.tag] -= 1
                self.scopes.pop()
                self.names.pop()
            else:
                self.scopes[-1][node.tag] -= 1

    def near(self, tag: str) -> bool:
        """Whether `tag` is open with no fence above it, or is the nearest fence."""
        return self.scopes[-1][tag] > 0 or self.names[-1] == tag


def parse(html: str) -> Node:
    """A DOM tree; kids are texts (references decoded) and nodes. Linear in the page; never fails
    on broken markup: a tag that the page's end cuts off is dropped with what follows it."""
    root = Node("html", None)
    open_, lost, at, size = _Open(root), set(), 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            open_.stack[-1].kids.append(_decoded(html[at:begin]))
        at = begin
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            open_.stack[-1].kids.append(html[at + 9 : end if end >= 0 else size])
            at = end + 3 if end >= 0 else size
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = end + 1 if end >= 0 else size
        elif at < size:
            closing = html.startswith("</", at)
            name = _NAME.match(html, at + 1 + closing)
            if not name:
                open_.stack[-1].kids.append("<")
                at += 1
                continue
            at = _tag_end(html, name.end(), lost)
            if at < 0:
                break
            if closing:
                _leave(open_, name[0].lower())
            else:
                at = _enter(open_, name[0].lower(), html[name.end() : at - 1], html, at)
    return root


def _leave(open_: _Open, tag: str) -> None:
    if tag in _FENCE and open_.fences[tag] or tag not in _FENCE and open_.scopes[-1][tag]:
        open_.pop_to({tag})
    elif tag == "p":
        open_.stack[-1].kids.append(Node("p", open_.stack[-1]))


def _enter(open_: _Open, tag: str, attrs: str, html: str, at: int) -> int:
    """Adds an element; returns where the page goes on."""
    if tag == "html" or tag == "body" and open_.fences["body"]:
        return at
    if tag in _CLOSES_P and open_.near("p"):
        open_.pop_to({"p"})
    for ends in _SIBLINGS.get(tag, ()):
        if open_.near(ends):
            open_.pop_to({ends})
    node = Node(tag, open_.stack[-1])
    _marks(node, attrs)
    node.parent.kids.append(node)
    if tag in _RAW:
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
        at = html.find(">", end.end()) + 1 if end else 0
        return at or len(html)
    if tag not in _VOID and not attrs.endswith("/"):
        open_.push(node)
    return at


def _order(root: Node) -> list[Node]:
    """Nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def _count(nodes: list[Node]) -> None:
    """Characters, tags, and those of links of every subtree; what is out counts nothing."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        if node.out:
            continue
        for kid in node.kids:
            if isinstance(kid, Node):
                node.chars += kid.chars
                node.tags += kid.tags + (not kid.out)
                node.link_chars += kid.chars if kid.tag == "a" else kid.link_chars
                node.link_tags += kid.link_tags + (kid.tag == "a" and not kid.out)
            else:
                node.chars += sum(map(len, kid.split()))


def _penalties(nodes: list[Node]) -> None:
    """Settles what is out: a marked element that is not an article's wrapper, and headers.

    A mark by class, id or role does not count on an element that holds an article or main
    element or more than half of the page's text. Headers are out; of one inside an article
    the headings stay.
    """
    wraps = set()
    for node in reversed(nodes):
        if node.tag in ("article", "main") or id(node) in wraps:
            wraps.add(id(node.parent))
    marked = [n for n in nodes if n.out]
    for node in marked:
        node.out = node.tag in _RAW
    _count(nodes)
    controls: Counter = Counter()
    for node in reversed(nodes):
        controls[id(node.parent)] += controls[id(node)] + (node.tag in _CONTROLS)
    for node in marked:
        # a form or dialog whose text outweighs what it asks for is a block like any other
        asks = node.tag in ("form", "dialog") and node.chars - node.link_chars <= _FORM_CHARS * (1 + controls[id(node)])
        by_tag = asks or node.tag in _OUT_TAGS and node.tag not in ("form", "dialog")
        node.out = id(node) not in wraps and (by_tag or node.named and 2 * node.chars <= nodes[0].chars)
    inside, head = set(), set()
    for node in nodes:
        up = id(node.parent)
        if node.tag in ("article", "main") or up in inside:
            inside.add(id(node))
        if up in head:
            head.add(id(node))
        if node.header and id(node) not in wraps and 2 * node.chars <= nodes[0].chars:
            if id(node) in inside:
                head.add(id(node))
            else:
                node.out = True
    # in an article's header only headings stay: all else, and texts beside them, go
    stays = set()
    for node in nodes:
        if id(node) in head:
            if _HEADING.fullmatch(node.tag) or id(node.parent) in stays:
                stays.add(id(node))
            else:
                node.kids = [k for k in node.kids if isinstance(k, Node)]


_HEADING = re.compile("h[1-6]")


def density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite text density: characters per tag, with a logarithm that links lower.

    c, t: characters and tags; lc, lt: those of links; share: of the body's characters in links.
    """
    if not c:
        return 0.0
    t, scale = max(t, 1), math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e))
    return c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / max(scale, _LEAST_SCALE)


def article(root: Node) -> list[Node]:
    """The subtrees of the main text, in page order.

    The node with the greatest sum of its child blocks' densities is the article. The least
    density on its path to the body is the threshold: of every node that reaches it, all
    nodes above it too, the subtree's node with the greatest sum is main text as well.
    """
    nodes = _order(root)
    _penalties(nodes)
    _count(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    top: dict[int, Node] = {}
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        kids = [k for k in node.kids if isinstance(k, Node)]
        node.total = sum(k.density for k in kids if k.tag not in _PHRASE)
        best = max((top[id(k)] for k in kids), key=lambda n: n.total, default=node)
        top[id(node)] = best if best.total > node.total else node
    best = up = top[id(body)]
    threshold = best.density
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    chosen, out, stack = set(), [], [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and node.chars:
            chosen.add(id(top[id(node)]))
            stack += [k for k in node.kids if isinstance(k, Node)]
    stack = [body]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            out.append(node)
        else:
            stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks, white space as one space, empty ones left out."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    stack: list = []
    for node in reversed(nodes):
        stack += [None, node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            now.append(item)
        elif not item.out:
            if item.tag in ("br", "td", "th", "wbr"):
                now.append(" " if item.tag != "wbr" else "")
            if item.tag not in _INLINE:
                end()
                stack.append(None)
            stack += reversed(item.kids)
    end()
    return out


def main_text(html: str) -> str:
    return "\n".join(blocks(article(parse(html))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars (code points).

    A null or empty page has an empty text. Broken markup is read as far as it goes: unclosed
    elements end with their parents, unknown references stay as they are. Pages are
    independent rows: repeated rows, ties and null ids give one row each; other columns are
    ignored; an empty table gives no rows. The whole page is read, whatever its length.
    """
    clean = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_text"))

    def work(texts: list[str]) -> dict[str, list]:
        found = [main_text(t) for t in texts]
        return {"text": found, "n_chars": [len(t) for t in found]}

    out = map_texts(clean, work, "text string, n_chars long", carry=("_id", "_url"))
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
