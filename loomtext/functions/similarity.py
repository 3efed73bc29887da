"""String measures that Spark lacks, as Arrow-batched functions over pairs.

They run on columns of short strings (words, titles, distinct vocabulary), never
on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F


def _distances(a: str, b: str) -> list[list[int]]:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows


def edit_script(a, b) -> list[tuple[str, str, str]]:
    """(operation, from, to) of a cheapest edit; going back, a diagonal step is
    preferred, then an insertion, then a deletion (a fixed order)."""
    d, i, j = _distances(a, b), len(a), len(b)
    out = []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out.append(("match" if a[i - 1] == b[j - 1] else "substitute", a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif j and d[i][j] == d[i][j - 1] + 1:
            out.append(("insert", "", b[j - 1]))
            j -= 1
        else:
            out.append(("delete", a[i - 1], ""))
            i -= 1
    return out[::-1]


def alignment(a: str, b: str) -> str:
    """Three lines: a, marks (| * + -) and b, with - for gaps and _ for spaces."""
    marks = {"match": "|", "substitute": "*", "insert": "+", "delete": "-"}
    show = lambda c: "_" if c == " " else c or "-"
    script = edit_script(a, b)
    return "\n".join("".join(parts) for parts in ((show(x) for _, x, _ in script), (marks[o] for o, _, _ in script), (show(y) for _, _, y in script)))


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = {(-1, -1): top}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = top, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = top, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            seen = j if same else seen
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    other = [y for y, u in zip(b, used, strict=True) if u]
    half = sum(x != y for x, y in zip(mine, other, strict=True)) // 2  # whole transpositions
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four letters."""
    s, prefix = jaro(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return s + prefix * 0.1 * (1 - s) if s > 0.7 else s


def _pairwise(measure: Callable, kind: str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def damerau_column() -> Callable[[Column, Column], Column]:
    """Damerau-Levenshtein distance of two columns."""
    return _pairwise(damerau, "int")


def jaro_winkler_column() -> Callable[[Column, Column], Column]:
    """Jaro-Winkler similarity of two columns."""
    return _pairwise(jaro_winkler, "double")


def alignment_column() -> Callable[[Column, Column], Column]:
    """Alignment of two columns as three lines."""
    return _pairwise(alignment, "string")


def edit_script_column() -> Callable[[Column, Column], Column]:
    """Edit script of two columns, one "operation:from:to" for each step."""
    return _pairwise(lambda a, b: ["".join((o, ":", x, ":", y)) for o, x, y in edit_script(a, b)], "array<string>")


def word_distance_column() -> Callable[[Column, Column], Column]:
    """Levenshtein distance of two token arrays."""
    return _pairwise(lambda a, b: _distances(list(a), list(b))[-1][-1], "int")
