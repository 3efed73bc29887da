"""Treebank tokens by ordered rewrite rules, and their inverse; all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: The published rules of the Penn Treebank's tokeniser (fixed values), in their order; commas and
#: colons before digits stay. Each is a pattern and what replaces it.
RULES = [
    (r'^"', "`` "),
    (r'([ (\[{<])"', "$1 `` "),
    (r"\.\.+", " $0 "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])\z", " $1 "),
    (r"[;@#$%&]", " $0 "),
    (r"([^.])([.])([\])}>\"']*)[ \t\n\r\f]*\z", "$1 $2$3 "),
    (r"[?!]", " $0 "),
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    (r"\z", " "),
    (r"\A", " "),
    (r'"', " '' "),
    (r"([^'])' ", "$1 ' "),
    (r"([^' ])('[sSmMdD]) ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r" ([Cc]an)(not) ", " $1 $2 "),
    (r" ([Gg]im)(me) ", " $1 $2 "),
    (r" ([Gg]on)(na) ", " $1 $2 "),
    (r" ([Gg]ot)(ta) ", " $1 $2 "),
    (r" ([Ll]em)(me) ", " $1 $2 "),
    (r" ([Ww]an)(na) ", " $1 $2 "),
    (r" ('[Tt])(is) ", " $1 $2 "),
    (r" ('[Tt])(was) ", " $1 $2 "),
]
#: Their inverse (fixed values), over tokens joined by single blanks with one before and after.
INVERSE = [
    (r" ('[Tt]) (is|was) ", " $1$2 "),
    (r" ([Cc]an) (not) ", " $1$2 "),
    (r" ([Gg]im) (me) ", " $1$2 "),
    (r" ([Gg]on) (na) ", " $1$2 "),
    (r" ([Ll]em) (me) ", " $1$2 "),
    (r" ([Ww]an) (na) ", " $1$2 "),
    (r" ([Gg]ot) (ta) ", " $1$2 "),
    (r" ('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]) ", "$1 "),
    (r" `` ", ' "'),
    (r" ''", '"'),
    (r" ([\])}>])", "$1"),
    (r"([\[({<]) ", "$1"),
    (r" ([.,:;?!%])", "$1"),
    (r"([$#]) ", "$1"),
    (r" -- ", "--"),
]


def _rewritten(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def tokens(sentence: Column) -> Column:
    """The tokens of one sentence; null and empty texts have none."""
    return F.filter(F.split(_rewritten(F.coalesce(sentence, F.lit("")), RULES), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def text_tokens(text: Column) -> Column:
    """The tokens of all sentences of a text, cut after . ! or ? and white space."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\r\f\x0B]+", "$1\u0001"), "\u0001")
    return F.flatten(F.transform(parts, tokens))


def joined(tokens: Column) -> Column:
    """The text of a sentence's tokens as it is usually spaced."""
    return F.trim(_rewritten(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), INVERSE))


#: Signs that stand close to what comes before them, and to what follows (fixed values).
CLOSE_BEFORE, CLOSE_AFTER = ".,!?;:)]}…%»”", "([{„«“"


def rendered(tokens: Column) -> Column:
    """Tokens of a language model as text: a blank between two, but for signs that stand close."""
    before, after = (re.escape(x) for x in (CLOSE_BEFORE, CLOSE_AFTER))
    text = F.concat(F.array_join(tokens, " "), F.lit(" "))
    return F.rtrim(F.regexp_replace(F.regexp_replace(text, rf" ([{before}])(?= )", "$1"), rf"([{after}]) (?=[^ ])", "$1"))


def rendered_units(tokens: Column, end: str) -> Column:
    """The units that ``end`` closes, a line for each that isn't empty."""
    parts = F.split(F.array_join(F.transform(tokens, lambda t: F.when(t == end, "\u0001").otherwise(F.concat(t, F.lit("\u0002")))), ""), "\u0001")
    units = F.filter(F.transform(parts, lambda u: F.filter(F.split(u, "\u0002"), lambda t: t != "")), lambda u: F.size(u) > 0)
    return F.array_join(F.transform(units, rendered), "\n")
