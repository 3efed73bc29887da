"""HTML extraction by composite text density.

A page becomes a tree of elements; end tags that HTML lets a page leave out are
implied. What the contract of the scan names is marked as no content: navigation,
footers, sidebars, forms and page headers by their tags and roles; adverts, notices,
menus and the like by a whole part of a class or id, never on html, body,
main, article, a heading or what holds an article, main or h1; elements that are
``hidden`` or ``aria-hidden="true"``; what readers write (see ``_cut_comments``), whether its
comments are articles of their own or not. Parsing takes time in proportion to the page.

For every other node the link-adjusted density of characters per tag is computed; a
node's sum is that of its children's densities. The subtree of the largest sum is
content as a whole. The smallest density on its path up to the body is the
threshold: beside each node of the path, a block whose density reaches it and
that isn't mostly links is content too, and so are headings and paragraphs
there, and inside the article or main of the path all that isn't mostly links.

Of equal largest sums the outer node's, then the first one's subtree is taken. Null and empty pages give the empty text; a page without markup gives its text.
A page of any length is parsed whole; repeated rows give equal rows; an empty table
gives an empty one; a column of pages that is named text or n_chars is replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._frames import with_arrow_columns

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: One attribute with its whole value, so that no value is searched for names.
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
#: Elements whose content is no markup.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FOREIGN = {"svg", "math"}
_CUT = {"nav", "footer", "aside", "form", "dialog", "menu", "label", "fieldset", "button", "select", "option", "optgroup", "datalist", "svg", "canvas", "object", "audio", "video", "head"}
_CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_KEPT = {"html", "body", "article", "main", *_HEADINGS}
_BODY = {"body", "html", "#root"}
_PROSE = {"p", "blockquote", "pre", "figcaption", *_HEADINGS}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math", "mrow", "mi", "mn", "mo", "msup", "msub", "mfrac", "msqrt", "mtext", "semantics"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"}} | {h: _HEADINGS for h in _HEADINGS}
_LIMITS = {"ul", "ol", "table", "dl", "div", "article", "section", "main", "body", "blockquote", "select"}
#: Parts of a class or id that name no content ...
_UNWANTED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "masthead", "footer", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "recommendations", "cta", "gdpr", "alert", "dropdown", "search", "toolbar", "widget", "header"}
#: ... as the only part of a name on a paragraph or an inline element,
_ALONE = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "cookie", "notice", "breadcrumb", "breadcrumbs", "newsletter", "alert", "gdpr", "cta", "comment", "comments"}
#: or as the first of several;
_FIRST = {"share", "sharing", "social"}
#: parts that name what readers write: always, and outside an article only (a paper has a discussion too);
_COMMENTS = re.compile(r"comment(s|ers?|list|form|box|area|section|thread)?\d*|disqus|respond|repl(y|ies)\d*")
_TALK = re.compile(r"discuss(ions?)?|responses?|thread")
#: unless the name says what else is there,
_BESIDE = {"has", "with", "without", "no", "hide", "show", "is"}
#: or is one of the layout that only has such a part in its middle;
_LAYOUT = {"left", "right", "content", "layout", "main", "page", "wrapper", "container", "body", "article", "post", "entry"}
#: the header of one of these is the article's own.
_OWN_HEADER = {"article", "post", "entry", "content", "story"}
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("block", "chars", "cut", "density", "items", "link_chars", "link_tags", "named", "open", "parent", "scope", "sum", "tag", "tags", "talk", "top", "within")

    def __init__(self, tag: str, parent: _Node | None) -> None:
        self.tag, self.parent, self.items = tag, parent, []
        self.cut = self.named = self.talk = False
        #: the block and the container that it stands in (or is), and their open inline and block elements
        self.block = self if parent is None or tag not in _INLINE else parent.block
        self.scope = self if parent is None or tag in _LIMITS else parent.scope
        self.open: Counter[str] | None = Counter() if self.block is self or self.scope is self else None
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.top = self

    @property
    def inner(self) -> list[_Node]:
        return [x for x in self.items if isinstance(x, _Node) and not x.cut]

    @property
    def linked(self) -> bool:
        return 2 * self.link_chars > self.chars


def _attributes(text: str) -> dict[str, str]:
    """Names and values; of a name that repeats, the first holds."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def _names_no_content(tag: str, name: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if tag in _INLINE or tag in _PROSE or tag == "li":
        return parts[0] in _FIRST if len(parts) > 1 else bool(parts) and parts[0] in _ALONE
    found = [x in _UNWANTED and not (k and parts[k - 1] in _BESIDE) and not (x == "header" and parts[0] in _OWN_HEADER) for k, x in enumerate(parts)]
    return any(found) and (parts[0] not in _LAYOUT or found[-1])


def _names_comments(node: _Node, name: str) -> bool:
    """Whether a name says that readers write here."""
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if any(parts[k - 1] in _BESIDE for k, x in enumerate(parts) if k and _COMMENTS.fullmatch(x)):
        return False
    if any(_COMMENTS.fullmatch(x) for x in parts):
        return parts[0] not in _LAYOUT or bool(_COMMENTS.fullmatch(parts[-1]))
    return "-".join(parts) in ("author-bio", "about-author", "authorbio") or (not node.within and any(_TALK.fullmatch(x) for x in parts) and parts[0] not in _LAYOUT)


def _mark(node: _Node, attributes: str) -> None:
    """cut: no content by its tag, role or state; named: by its names; talk: by names of comments."""
    tag, own = node.tag, _attributes(attributes)
    if tag in _CUT or tag == "header" and not node.within:
        node.cut = True
    elif tag not in ("html", "body", "article", "main") and ("hidden" in own or own.get("aria-hidden", "").strip() == "true"):
        node.cut = True
    elif tag not in _KEPT and own:
        node.cut = own.get("role", "").strip() in _CUT_ROLES
        names = own.get("class", "").split() + ([] if tag in _INLINE or tag in _PROSE else own.get("id", "").split())
        node.named = own.get("role") != "main" and any(_names_no_content(tag, n) for n in names)
    if tag not in ("html", "body", "main", *_HEADINGS) and tag not in _INLINE and tag != "p" and own:
        names = own.get("class", "").split() + own.get("id", "").split()
        node.talk = "comment" in own.get("itemtype", "") or own.get("itemprop", "") == "comment" or any(_names_comments(node, n) for n in names)


def parse_page(page: str) -> _Node:
    """The tree of a page; items are nodes, texts and breaks (None). Open elements are counted, inline ones
    for each block and blocks for each container, so no end tag or implied end looks for what isn't there."""
    root = _Node("#root", None)
    node, at, foreign = root, 0, None
    opened: Counter[str] = Counter()

    def left(now: _Node, upto: _Node) -> _Node:
        """Leaves the elements inside ``upto``, an ancestor."""
        while now is not upto:
            if now.tag in _INLINE:
                now.block.open[now.tag] -= 1
            else:
                opened[now.tag] -= 1
                now.parent.scope.open[now.tag] -= 1
            now = now.parent
        return now

    last = page.rfind(">") + 1  # no tag ends after it
    while at <= len(page):
        m = _TAG.search(page, at, last)
        if text := page[at : m.start() if m else len(page)]:
            node.items.append(text)
        if not m:
            break
        at = len(page) if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in ("html", "body") and (node.block.open[tag] if tag in _INLINE else opened[tag]):
                walk = node
                while walk.tag != tag:
                    walk = walk.parent
                node = left(node, walk.parent)
                foreign = foreign if foreign is not walk else None
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                node.items.append(None)
            continue
        if tag not in _INLINE and not foreign:
            if node.block.tag == "p":
                node = left(node, node.block.parent)
            scope = node.scope
            walk, ends, n = node, node, sum(scope.open[t] for t in _CLOSES.get(tag, ()))
            while n:
                if walk.tag in _CLOSES[tag]:
                    ends, n = walk.parent, n - 1
                walk = walk.parent
            node = left(node, ends)
        child = _Node(tag, node)
        _mark(child, attributes)
        node.items.append(child)
        if not (attributes.endswith("/") and (foreign or tag in _FOREIGN)):
            if tag in _INLINE:
                node.block.open[tag] += 1
            else:
                opened[tag] += 1
                node.scope.open[tag] += 1
            node = child
            if tag in _FOREIGN and not foreign:
                foreign = child
    return root


def _cut_comments(every: list[_Node]) -> None:
    """Cuts what readers write. ``every``: the nodes in the order of the page.

    The page's own is its first article that isn't named as comments, else such a main, else such an h1. A
    container named as comments is cut unless it holds that. So is an article inside the page's own that
    names a time, and lists of two or more articles with a time each that stand apart from it."""
    talking = {id(n) for n in every if n.talk}  # in the order of the page, so parents come before what they hold
    for n in every:
        if n.parent is not None and id(n.parent) in talking:
            talking.add(id(n))
    own = next((n for tag in ("article", "main", "h1") for n in every if n.tag == tag and id(n) not in talking), None)
    own = own or next((n for tag in ("article", "main", "h1") for n in every if n.tag == tag), None)
    above, walk = set(), own
    while walk is not None:
        above.add(id(walk))
        walk = walk.parent
    under: set[int] = {id(own)} if own is not None else set()
    article: dict[int, _Node | None] = {}  # the nearest article of each node
    timed: set[int] = set()  # articles with a time of their own
    lists: dict[int, list[_Node]] = {}
    for n in every:
        if id(n.parent) in under:
            under.add(id(n))
        article[id(n)] = n if n.tag == "article" else article.get(id(n.parent))
        if n.tag == "time" and article[id(n)] is not None:
            timed.add(id(article[id(n)]))
        if n.tag == "article" and id(n) not in above:
            lists.setdefault(id(n.parent), []).append(n)
        if n.talk and id(n) not in above:
            n.cut = True
    if own is not None and own.tag == "article":
        for articles in lists.values():
            up = articles[0].parent
            apart = len(articles) > 1 and id(up) not in above and all(id(n) in timed for n in articles)
            for n in articles:
                n.cut = n.cut or apart or (id(n) in under and id(n) in timed)


def _measure(root: _Node) -> None:
    every, stack = [], [root]
    while stack:
        every.append(node := stack.pop())
        stack += [x for x in reversed(node.items) if isinstance(x, _Node)]
    _cut_comments(every)
    holders: set[int] = set()  # what holds an article, main or h1 isn't cut by its names
    for node in reversed(every):
        if id(node) in holders or node.tag in ("article", "main", "h1") and not node.cut:
            node.named = False
            holders.add(id(node.parent))
        node.cut = node.cut or node.named
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        stack += node.inner
    for node in reversed(order):
        node.chars += sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    whole = max(root.chars, 1)
    for node in order:
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + root.link_chars / whole * c + math.e)
            node.density = c / t * max(math.log(c / max(lc, 1) * t / lt), 0.0) / base
    for node in reversed(order):
        inner = node.inner
        node.sum = sum(x.density for x in inner)
        node.top = max([node, *(x.top for x in inner)], key=lambda x: x.sum)


def _blocks(node: _Node, out: list[list[str]], wanted=None) -> None:
    """Texts of the blocks of a node; wanted: of a node's items, those to take."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.cut:
            items = x.items if wanted is None else wanted(x)
            stack += reversed(items) if x.tag in _INLINE else [None, *reversed(items), None]
        elif x.tag not in _INLINE:
            stack.append(None)


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by one newline."""
    if not page:
        return ""
    root = parse_page(page)
    _measure(root)
    best = root.top
    path, walk = [], best
    while walk is not None:
        path.append(walk)
        walk = walk.parent
    threshold = min((x.density for x in path if x.tag not in _BODY), default=0.0)
    within, inside = set(), False  # nodes of the path in an article or main
    for x in reversed(path):
        inside = inside or x.tag in ("article", "main")
        if inside:
            within.add(id(x))
    on_path = {id(x) for x in path[1:]}

    def wanted(x: _Node) -> list:
        if id(x) not in on_path:
            return x.items
        out: list = []
        for y in x.items:
            if not isinstance(y, _Node):
                out.append(y if y is None or id(x) in within or x.tag in _INLINE else None)
            elif id(y) in on_path or y is best:
                out.append(y)
            elif y.tag in _INLINE or not y.chars:
                out.append(y if id(x) in within else None)
            else:
                out.append(y if not y.linked and (id(x) in within or y.tag in _PROSE or y.density >= threshold - 1e-9) else None)
        return out

    out: list[list[str]] = [[]]
    _blocks(root, out, wanted)
    texts = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in out)
    return "\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns but the page itself, with text and n_chars."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def make(batch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(x.as_py()) for x in part.column(column)]
            yield part, [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_arrow_columns(pages, fields, make).drop(column)
