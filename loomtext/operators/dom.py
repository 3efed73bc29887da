"""Records from pages: elements chosen by selectors, one row each.

A selector is a list of alternatives (``,``), each a chain of simple selectors, joined by a
blank (anywhere inside) or ``>`` (a child). A simple selector is a tag or ``*``, then any of
``.class``, ``#id``, ``[attribute]`` and ``[attribute=value]``.

Pages are parsed where they are read, in Arrow batches; trees live for one page
only. Character references are decoded; elements that need no end tag are closed by
what follows them in the same container; an end tag without an open element is ignored, and
only a container's end tag closes containers. Open elements are counted by tag in each
container, so a page costs time in proportion to its length, however it is written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Elements without content, and for each element the open ones that it closes, up to a container (fixed values of HTML).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}} | {
    block: {"p"} for block in ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")
}
CONTAINERS = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "body", "html"}
HIDDEN = {"script", "style", "template", "title"}


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    items: list = field(default_factory=list)

    def text(self) -> str:
        """The text inside with single blanks; scripts and styles are none."""
        parts: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in HIDDEN or x is self:
                todo += [" ", *reversed(x.items), " "] if x.tag in CLOSES or x.tag == "br" else [*reversed(x.items)]
        return " ".join("".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("#root", {}, None)
        self.every: list[Element] = []  # in the order of the page
        self.containers: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # open elements of each open container

    def _leave(self, upto: Element) -> None:
        """Closes the open elements up to this one."""
        while True:
            closed, self.now = self.now, self.now.parent
            if closed.tag in CONTAINERS:
                self.scopes.pop()
                self.containers[closed.tag] -= 1
            else:
                self.scopes[-1][closed.tag] -= 1
            if closed is upto:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, scope = CLOSES.get(tag, ()), self.scopes[-1]
        last = "tr" if tag == "tr" and scope["tr"] else next((t for t in closes if scope[t]), None)
        if last:
            walk = self.now
            while walk.tag != last if last == "tr" else walk.tag not in closes:
                walk = walk.parent
            self._leave(walk)
        attributes: dict[str, str] = {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")
        new = Element(tag, attributes, self.now)
        self.now.items.append(new)
        self.every.append(new)
        if tag in VOID:
            return
        self.now = new
        if tag in CONTAINERS:
            self.scopes.append(Counter())
            self.containers[tag] += 1
        else:
            self.scopes[-1][tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.containers[tag] if tag in CONTAINERS else self.scopes[-1][tag]:
            walk = self.now
            while walk.tag != tag:
                walk = walk.parent
            self._leave(walk)

    def handle_data(self, data: str) -> None:
        self.now.items.append(data)


_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")


def _closed_only(page: str) -> str:
    """The page with the & of whatever isn't a whole reference written as one."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:], page)


def parse(page: str, closed_only: bool = False) -> list[Element]:
    """All elements of a page, in their order; with ``closed_only`` references that no
    semicolon ends are text, where browsers decode some of them."""
    builder = _Builder()
    builder.feed(_closed_only(page) if closed_only else page)
    builder.close()
    return builder.every


@dataclass(frozen=True)
class Simple:
    """One simple selector; ``child``: it must be the direct parent of what follows."""

    tag: str
    classes: tuple[str, ...]
    ids: tuple[str, ...]
    attributes: tuple[tuple[str, str | None], ...]
    child: bool

    def fits(self, e: Element) -> bool:
        own = e.attributes
        return (
            self.tag in ("*", e.tag) and set(self.classes) <= set(own.get("class", "").split()) and all(own.get("id") == i for i in self.ids)
            and all(n in own and (v is None or own[n] == v) for n, v in self.attributes)
        )


_SIMPLE = re.compile(r"""(\*|[\w-]+)?((?:[.#][\w-]+|\[[\w-]+(?:=(?:"[^"]*"|'[^']*'|[^\]]*))?\])*)""")
_PART = re.compile(r"""([.#])([\w-]+)|\[([\w-]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\]]*)))?\]""")


def compile_selector(text: str) -> list[list[Simple]]:
    """The alternatives, each from the last simple selector to the first."""
    out = []
    for alternative in text.split(","):
        chain: list[Simple] = []
        child = False
        for token in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", alternative):
            if token == ">":
                if child or not chain:
                    raise ValueError(f"no selector before > in {text!r}")
                child = True
                continue
            m = _SIMPLE.fullmatch(token)
            if not m:
                raise ValueError(f"no selector: {token!r}")
            parts = list(_PART.finditer(m[2]))
            values = lambda p: next((p[k] for k in (4, 5, 6) if p[k] is not None), None)
            if chain:
                chain[-1] = Simple(chain[-1].tag, chain[-1].classes, chain[-1].ids, chain[-1].attributes, child)
            chain.append(Simple((m[1] or "*").lower(), tuple(p[2] for p in parts if p[1] == "."), tuple(p[2] for p in parts if p[1] == "#"), tuple((p[3].lower(), values(p)) for p in parts if p[3]), False))
            child = False
        if child or not chain:
            raise ValueError(f"no selector in {text!r}")
        out.append(chain[::-1])
    return out


def matches(e: Element, selector: list[list[Simple]], scope: Element | None = None) -> bool:
    """Whether the element is chosen; with ``scope``, by a chain that lies inside it."""

    def above(e: Element, chain: list[Simple]) -> bool:
        if not chain:
            return True
        walk = e.parent
        while walk is not None and walk is not scope:
            if chain[0].fits(walk) and above(walk, chain[1:]):
                return True
            if chain[0].child:
                return False
            walk = walk.parent
        return False

    return any(chain[0].fits(e) and above(e, chain[1:]) for chain in selector)


def records(pages: DataFrame, rows: str, fields: dict[str, str], key: str = "page_id", html: str = "html", closed_only: bool = False) -> DataFrame:
    """key, record (from 0 in each page), tag and one column for each field of the elements that ``rows`` chooses.
    A field is a selector inside the record, with ``@name`` after it for an attribute, or ``@name``
    alone for the record's own; its first element's text or attribute is the value, null if
    there is none. ``#count:`` before a selector counts the elements. ``closed_only``: see ``parse``."""
    chosen = compile_selector(rows)
    plans: list[tuple[str, list[list[Simple]] | None, str | None]] = []
    for spec in fields.values():
        count = spec.startswith("#count:")
        selector, _, attribute = spec.removeprefix("#count:").partition("@")
        plans.append(("count" if count else "first", compile_selector(selector) if selector.strip() else None, attribute or None))
    schema = T.StructType([pages.schema[key], T.StructField("record", T.IntegerType()), T.StructField("tag", T.StringType()), *(T.StructField(n, T.LongType() if p[0] == "count" else T.StringType()) for n, p in zip(fields, plans, strict=True))])

    def value(plan, row: Element, inside: list[Element]):
        how, selector, attribute = plan
        if selector is None:
            return row.attributes.get(attribute) if attribute else row.text()
        found = (e for e in inside if matches(e, selector, row))
        if how == "count":
            return sum(1 for _ in found)
        first = next(found, None)
        return None if first is None else first.attributes.get(attribute) if attribute else first.text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, columns = [], [[] for _ in range(2 + len(plans))]
            for k, page in enumerate(batch.column(1).to_pylist()):
                every = parse(page or "", closed_only)
                place = {id(e): n for n, e in enumerate(every)}
                for number, row in enumerate(e for e in every if matches(e, chosen)):
                    stop, todo = place[id(row)], row
                    while (inner := [x for x in todo.items if isinstance(x, Element)]) and (todo := inner[-1]):  # the last element inside
                        stop = place[id(todo)]
                    inside = every[place[id(row)] + 1 : stop + 1]
                    owner.append(k)
                    for column, v in zip(columns, [number, row.tag, *(value(p, row, inside) for p in plans)], strict=True):
                        column.append(v)
            kinds = [pa.int32(), pa.string(), *(pa.int64() if p[0] == "count" else pa.string() for p in plans)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    return pages.select(key, html).mapInArrow(run, schema)
