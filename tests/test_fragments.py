"""Best fragments and similar extents against every possibility."""

import random
import re

import pytest

from loomtext.operators import search as S


def triples(word):
    return [f"  {word} "[k : k + 3] for k in range(len(word) + 1)]


def best_extent(query, title):
    wanted = set(triples(query))
    ordered = [g for w in re.findall(r"[^\W_]+", title) for g in triples(w)]
    runs = [set(ordered[a:b]) for a in range(len(ordered)) for b in range(a + 1, len(ordered) + 1)]
    return max((len(wanted & r) / len(wanted | r) for r in runs), default=0.0)


def test_extents_equal_every_run(spark):
    rng = random.Random(21)
    titles = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 6))) for _ in range(250)] + ["", None, "abcab", "ABCAB-x", "abc ab cab"]
    docs = spark.createDataFrame(list(enumerate(titles)), "doc_id int, title string")
    for word, threshold in [("abcab", 0.6), ("abcab", 0.3), ("ab", 0.6), ("cabbac", 0.45)]:
        got = {r.doc_id: r.similarity for r in S.similar_titles(docs, "title", word, threshold).collect()}
        every = {k: best_extent(word, (t or "").lower()) for k, t in enumerate(titles)}
        assert got == pytest.approx({k: s for k, s in every.items() if s >= threshold})
    assert S.extent_similarity("word", "two words", 0.6) == pytest.approx(0.8)  # known value of the measure


def fragment(body, words, least, most):
    parts = re.findall(r"[^\W_]+[\W_]*", body)
    hits = [k for k, p in enumerate(parts) if re.match(r"[^\W_]+", p)[0].lower() in words]
    begin = last = 0
    if hits:
        runs = []
        for k in hits:
            inside = [j for j in hits if k <= j < k + most]
            runs.append((-len({re.match(r"[^\W_]+", parts[j])[0].lower() for j in inside}), -len(inside), inside[-1] - k, k, inside[-1]))
        *_, begin, last = min(runs)
    stop = min(max(last + 1, begin + least), len(parts))
    begin = max(min(begin, stop - least), 0)
    out = "".join(re.sub(r"^([^\W_]+)", r"<em>\1</em>", parts[k]) if k in hits else parts[k] for k in range(begin, stop))
    return re.sub(r"[^\w>]+$", "", out)


def test_best_fragments_equal_every_window(spark):
    rng = random.Random(22)
    signs = [" ", ", ", "\n", " - "]
    bodies = ["".join(rng.choice(["kot", "Pies", "dom", "las", "rzeka", "x", "lot"]) + rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", "(kot)", "las. " * 40, "kot kot kot"]
    docs = spark.createDataFrame([(k, "", b) for k, b in enumerate(bodies)], "doc_id int, title string, body string")
    index = S.in_memory(S.postings(docs, ("title", "body")))
    for least, most in [(12, 25), (3, 5), (1, 1)]:
        got = {r.doc_id: r.fragment for r in S.best_fragments(index, docs.selectExpr("doc_id", "'body' AS field", "body AS text"), ("kot", "pies", "dom"), least, most).collect()}
        assert got == {k: fragment(b, {"kot", "pies", "dom"}, least, most) for k, b in enumerate(bodies)}
