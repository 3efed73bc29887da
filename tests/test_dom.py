"""Selectors over parsed pages against the trees that the pages were written from."""

import html
import random
import time

import pytest

from loomtext.operators import dom as D


class Tree:
    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.items = tag, attributes, parent, []

    def every(self):
        for x in self.items:
            if isinstance(x, Tree):
                yield x
                yield from x.every()

    def raw(self):
        return "".join(x if isinstance(x, str) else x.raw() if x.tag in ("b", "span", "a", "i") else f" {x.raw()} " for x in self.items)

    def text(self):
        return " ".join(self.raw().split())


def grown(rng, parent, depth):
    inside = {"ul": ["li"], "table": ["tr"], "tr": ["td"]}.get(parent.tag) or (["b", "span", "a", "i"] if parent.tag in ("p", "b", "span", "a", "i", "h1") else ["div", "p", "ul", "span", "table", "section", "h1", "b"])
    for _ in range(rng.randint(0, 4) if depth else 0):
        if rng.random() < 0.4 and parent.tag not in ("ul", "table", "tr"):
            parent.items.append(rng.choice(["x", "a & b", "<c>", " ż  ", "é\n"]))
            continue
        attributes = {}
        if rng.random() < 0.5:
            attributes["class"] = " ".join(rng.sample(["one", "two", "kol-cena"], rng.randint(1, 2)))
        if rng.random() < 0.2:
            attributes["id"] = rng.choice(["m", "n"])
        if rng.random() < 0.3:
            attributes["data-id"] = rng.choice(["1", "2 & 3"])
        child = Tree(rng.choice(inside), attributes, parent)
        parent.items.append(child)
        grown(rng, child, depth - 1)


def written(rng, tree):
    out = []
    for k, x in enumerate(tree.items):
        if isinstance(x, str):
            out.append(html.escape(x))
            continue
        quote = rng.choice(['"', "'"])
        out.append("<" + rng.choice([x.tag, x.tag.upper()]) + "".join(f" {n}={quote}{html.escape(v)}{quote}" for n, v in x.attributes.items()) + ">" + written(rng, x))
        after = tree.items[k + 1] if k + 1 < len(tree.items) else None
        closable = {"li": ("li",), "td": ("td",), "tr": ("tr",), "p": ("p", "div", "ul", "table", "section", "h1")}.get(x.tag, ())
        if not (isinstance(after, Tree) and after.tag in closable and rng.random() < 0.5):  # else what follows closes it
            out.append(f"</{x.tag}>" + ("</i></article>" if x.tag == "ul" and rng.random() < 0.1 else ""))
    return "".join(out)


def holds(e, simple):
    tag, classes, ids, attributes = simple
    return tag in ("*", e.tag) and all(c in e.attributes.get("class", "").split() for c in classes) and all(e.attributes.get("id") == i for i in ids) and all(n in e.attributes and (v is None or v == e.attributes[n]) for n, v in attributes)


def chosen(e, chain, scope):
    """chain: simple selectors and the combinators between them."""
    if not holds(e, chain[-1]):
        return False
    if len(chain) == 1:
        return True
    above, walk = [], e.parent
    while walk is not None and walk is not scope:
        above.append(walk)
        walk = walk.parent
    return any(chosen(a, chain[:-2], scope) for a in (above[:1] if chain[-2] == ">" else above))


S = {"div": ("div", [], [], []), ".one": ("*", ["one"], [], []), "p": ("p", [], [], []), "li": ("li", [], [], []), "#m": ("*", [], ["m"], []), "span.two": ("span", ["two"], [], []), "[data-id]": ("*", [], [], [("data-id", None)]), "td": ("td", [], [], []), '*[data-id="2 & 3"]': ("*", [], [], [("data-id", "2 & 3")]), "section": ("section", [], [], []), ".kol-cena.one": ("*", ["kol-cena", "one"], [], [])}
SELECTORS = [("div",), ("li",), (".one",), ("div", " ", ".one"), ("div", ">", "p"), ("div", " ", "div", ">", "span.two"), ("[data-id]",), ("td", " ", "#m"), ('*[data-id="2 & 3"]',), ("section", ">", "div", " ", ".kol-cena.one"), ("p",)]


def test_records_equal_the_written_trees(spark):
    rng = random.Random(31)
    trees = []
    for _ in range(150):
        root = Tree("body", {}, None)
        grown(rng, root, 5)
        trees.append(root)
    pages = spark.createDataFrame([(k, f"<!DOCTYPE html><!-- <p> --><body>{written(rng, t)}</body>") for k, t in enumerate(trees)], "page_id int, html string").cache()
    for number, chain in enumerate(SELECTORS):
        inner = SELECTORS[(number + 3) % len(SELECTORS)]
        text, inside = "".join(chain), "".join(inner)
        got = [tuple(r) for r in D.records(pages, text, {"text": "", "id": "@data-id", "first": inside, "n": f"#count:{inside}"}).collect()]
        expected = []
        for k, t in enumerate(trees):
            rows = [e for e in t.every() if chosen(e, [S.get(c, c) for c in chain], None)]
            for record, e in enumerate(rows):
                found = [x for x in e.every() if chosen(x, [S.get(c, c) for c in inner], e)]
                expected.append((k, record, e.tag, e.text(), e.attributes.get("data-id"), found[0].text() if found else None, len(found)))
        assert sorted(got, key=lambda r: r[:2]) == expected, text


def test_odd_pages(spark):
    pages = ["", None, "<", "<p", "no tags &amp; &eacute; &#x17c;", "</p></div>", "<li>a<li>b", "<p>a<div>b</p>c", "<script>if (a < b) '<p>'</script><p>x"]
    got = [(r.page_id, r.tag, r.text) for r in D.records(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), "p, li", {"text": ""}).collect()]
    assert sorted(got) == [(6, "li", "a"), (6, "li", "b"), (7, "p", "a"), (8, "p", "x")]
    for bad in ("", ">p", "p >", "p,,li", "p..x", "[", "p!"):
        with pytest.raises(ValueError):
            D.compile_selector(bad)


@pytest.mark.parametrize("unit", ["<b></i>", "<b>", "</b>", "<p><b>", "<li><ul><b>", "<td><tr>", "<div></b>", "<li><ul>" + "<b>" * 50 + "<li></li>"])
def test_pages_cost_time_in_proportion(unit):
    began = time.time()
    D.parse(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 20


def test_references_without_semicolon(spark):
    page = '<body><nav><ul><li><a href="/x?a=1&copy=2">a &lt b&middot</a></li></ul></nav><article><h1>one &amp; two&amp</h1><p>&notit; &quot;x&quot &#65; &#66</p></article></body>'
    rows = spark.createDataFrame([(1, page)], "page_id int, html string")
    one = lambda selector, fields, closed: [tuple(r)[3:] for r in D.records(rows, selector, fields, closed_only=closed).collect()]
    assert one("article", {"h": "h1"}, True) == [("one & two&amp",)] and one("article", {"h": "h1"}, False) == [("one & two&",)]
    assert one("article > p", {"t": ""}, True) == [('&notit; "x&quot A &#66',)]
    assert one("li", {"t": "a", "l": "a@href"}, True) == [("a &lt b&middot", "/x?a=1&copy=2")]
