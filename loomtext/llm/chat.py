"""Chat formatting with a sandboxed template language.

``compile_template`` parses a template into a syntax tree, folds constants and
generates Python closures. The language has text, ``{{ expression }}``,
``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set x = e %}`` and
``{% generation %}``, whose output is recorded as loss spans. Expressions have
literals, names, ``a.b`` and ``a['b']`` (keys of mappings only, never Python
attributes), comparison, ``and``/``or``/``not``, ``~`` and a fixed set of filters.
Nothing else of Python can be reached from a template.

Rows of one conversation are sorted by (turn, role, text); null role and text
are empty. A conversation is one output row, so its own text is what a task
holds; conversations are streamed one after the other. Rows that repeat are turns each; very long texts
are rendered whole. An empty table gives an
empty table; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Turns are ``### role: text</turn>``; # < : and \ inside values are escaped.
DEFAULT_TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't of the language."""


def escape(text: str) -> str:
    """No control string of the format stands in the result."""
    return re.sub(r"[\\#<:]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "capitalize": lambda x: _text(x).capitalize()}
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def _text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


# ---- syntax trees: tuples of a kind and its parts -------------------------

_MARK = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%(?P<tag>.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>~.|\[\]()]))")


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.joined()
        if op := self.take(*_COMPARE):
            left = ("compare", op, left, self.joined())
        return left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.take("~"):
            left = ("join", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.member()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = ("filter", name, value)
        return value

    def member(self) -> tuple:
        value = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                value = ("key", value, ("const", self.name()))
            else:
                value = ("key", value, self.either())
                if not self.take("]"):
                    raise TemplateError("] is missing")
        return value

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            value = self.either()
            if not self.take(")"):
                raise TemplateError(") is missing")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", value[1:-1])
        if kind == "num":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _MARK.finditer(source):
        parts += [("text", source[at : m.start()]), (m.lastgroup or "", m[m.lastgroup or 0].strip())]
        at = m.end()
    parts.append(("text", source[at:]))
    stream = iter([p for p in parts if p != ("text", "")])

    def block(*ends: str) -> tuple[tuple, str]:
        body = []
        for kind, value in stream:
            if kind == "text":
                body.append(("text", value))
            elif kind == "out":
                body.append(("out", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return ("block", *body), value
                if word == "for":
                    if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                        raise TemplateError("for needs: name in expression")
                    body.append(("for", m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    body.append(branch(rest))
                elif word == "generation":
                    body.append(("generation", block("endgeneration")[0]))
                elif word == "set":
                    name, eq, expr = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError("set needs: name = expression")
                    body.append(("set", name.strip(), _Expression(expr).whole()))
                else:
                    raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return ("block", *body), ""

    def branch(condition: str) -> tuple:
        test = _Expression(condition).whole()
        then, end = block("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        if word == "elif":
            return ("if", test, then, branch(rest))
        return ("if", test, then, block("endif")[0] if word == "else" else ("block",))

    return block()[0]


def fold(tree: tuple) -> tuple:
    """Constant expressions are computed, constant branches chosen, and texts
    that stand side by side joined."""
    kind = tree[0]
    if kind in ("text", "const", "name"):
        return tree
    tree = (kind, *(fold(x) if isinstance(x, tuple) else x for x in tree[1:]))
    if kind in ("or", "and", "not", "compare", "join", "filter", "key") and all(x[0] == "const" for x in tree[1:] if isinstance(x, tuple)):
        return ("const", _value(tree)({}))
    if kind == "out" and tree[1][0] == "const":
        return ("text", _text(tree[1][1]))
    if kind == "if" and tree[1][0] == "const":
        return tree[2] if tree[1][1] else tree[3]
    if kind == "block":
        flat = list(itertools.chain.from_iterable(x[1:] if x[0] == "block" else [x] for x in tree[1:]))
        body: list[tuple] = []
        for same, group in itertools.groupby(flat, key=lambda x: x[0] == "text"):
            body += [("text", "".join(x[1] for x in group))] if same else group
        return ("block", *body)
    return tree


# ---- closures -------------------------------------------------------------


class _Output:
    """Rendered parts, their length so far, and the spans under the loss."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.loss: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        return lambda env, x=tree[1]: x
    if kind == "name":
        return lambda env, x=tree[1]: env.get(x)
    if kind == "not":
        inner = _value(tree[1])
        return lambda env: not inner(env)
    if kind == "filter":
        inner, use = _value(tree[2]), FILTERS[tree[1]]
        return lambda env: use(inner(env))
    if kind == "compare":
        left, right, test = _value(tree[2]), _value(tree[3]), _COMPARE[tree[1]]
        return lambda env: test(left(env), right(env))
    left, right = _value(tree[1]), _value(tree[2])
    if kind == "or":
        return lambda env: left(env) or right(env)
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "join":
        return lambda env: _text(left(env)) + _text(right(env))

    def member(env: dict) -> Any:
        holder, key = left(env), right(env)
        if isinstance(holder, dict):
            return holder.get(key)
        return holder[key] if isinstance(holder, list) and isinstance(key, int) and 0 <= key < len(holder) else None

    return member


def _action(tree: tuple) -> Callable[[dict, _Output], None]:
    kind = tree[0]
    if kind == "text":
        return lambda env, out, x=tree[1]: out.write(x)
    if kind == "out":
        value = _value(tree[1])
        return lambda env, out: out.write(_text(value(env)))
    if kind == "block":
        actions = [_action(x) for x in tree[1:]]

        def run(env: dict, out: _Output) -> None:
            for act in actions:
                act(env, out)

        return run
    if kind == "if":
        test, then, other = _value(tree[1]), _action(tree[2]), _action(tree[3])
        return lambda env, out: (then if test(env) else other)(env, out)
    if kind == "set":
        value = _value(tree[2])
        return lambda env, out, name=tree[1]: env.update({name: value(env)})
    if kind == "generation":
        body = _action(tree[1])

        def mark(env: dict, out: _Output) -> None:
            start = out.length
            body(env, out)
            out.loss.append((start, out.length))

        return mark
    name, items, body = tree[1], _value(tree[2]), _action(tree[3])

    def loop(env: dict, out: _Output) -> None:
        values = items(env) or []
        for k, x in enumerate(values):
            body({**env, name: x, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": k == len(values) - 1}}, out)

    return loop


@dataclass(frozen=True)
class Rendered:
    """A conversation's text and the spans under the loss (code points)."""

    text: str
    loss: list[tuple[int, int]]


def compile_template(source: str) -> Callable[[list[dict]], Rendered]:
    """Parse, fold and close over: the result renders a list of messages."""
    act = _action(fold(parse(source)))

    def render(messages: list[dict]) -> Rendered:
        out = _Output()
        act({"messages": messages}, out)
        return Rendered("".join(out.parts), out.loss)

    return render


_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*+): ((?:[^\\#<:]|\\.)*+)</turn>\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a conversation in DEFAULT_TEMPLATE's format."""
    turns, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


# ---- Spark ----------------------------------------------------------------


def format_conversations(rows: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """conv_id, formatted text and loss spans of every conversation. Rows are
    dealt by conv_id and sorted inside the partitions, so a task streams."""
    compile_template(template)
    source = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = [dealt.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]

    def run(batches):
        render = compile_template(template)
        rows_in = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(b.column("conv_id"), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
        made: list[tuple] = []
        size, kind = 0, None
        for _, group in itertools.groupby(rows_in, key=lambda x: x[0].as_py()):
            first = next(group)
            kind = first[0].type
            done = render([first[1], *(m for _, m in group)])
            made.append((first[0].as_py(), done.text, [{"start": a, "end": b} for a, b in done.loss]))
            size += len(done.text)
            if size > 2_000_000 or len(made) >= 2000:
                yield _batch(made, kind)
                made, size = [], 0
        if made:
            yield _batch(made, kind)

    def _batch(made, kind):
        ids, texts, spans = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "loss_spans"])

    return dealt.mapInArrow(run, T.StructType(kinds))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as sums and hashes."""
    fields = [formatted.schema["conv_id"]] + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, pa.string() if k in (1, 3) else pa.int64()) for k, c in enumerate(out))], names=[f.name for f in fields])

    return formatted.mapInArrow(run, T.StructType(fields))
