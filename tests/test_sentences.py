"""The sentence learner against plain Python."""

import collections
import math
import random
import re

import regex
from pyspark.sql import functions as F

from loomtext.operators import sentences as N

CLOSE = r"""["')\]}»”’]*\Z"""


def analysed(text):
    tokens = [w for w in re.split("[ \t\n\r\f\v ]+", text) if w]
    rows = []
    for w in tokens:
        p = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\Z", "", w)
        kind = "hard" if re.search("[!?]" + CLOSE, w) else "dot" if re.search(r"\." + CLOSE, w) else None
        rows.append((kind, "##number##" if regex.match(r"\p{N}[\p{N}.,]*\Z", p) else p.lower(), bool(regex.match(r"\p{Lu}", p))))
    return rows


def binomial(hits, n, p):
    return 0.0 if p <= 0 or p >= 1 else hits * math.log(p) + (n - hits) * math.log(1 - p)


def ratio(a, b, both, n):
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    return -2 * (binomial(both, a, p) + binomial(b - both, n - a, p) - binomial(both, a, p1) - binomial(b - both, n - a, p2))


def brute(texts):
    """(abbreviations, starters, places of ends) as the docstrings say."""
    rows = [analysed(t) for t in texts]
    every = [x for r in rows for x in r if x[1]]
    c, dots = collections.Counter(w for _, w, _ in every), collections.Counter(w for k, w, _ in every if k == "dot")
    lower, upper = collections.Counter(w for _, w, u in every if not u), collections.Counter(w for _, w, u in every if u)
    begun = collections.Counter()
    pairs = []
    for r in rows:
        if r and r[0][2]:
            begun[r[0][1]] += 1
        for (k, w, _), (_, n, u) in zip(r, r[1:], strict=False):
            if k:
                begun[n] += u
                pairs.append((k, w, n, u))
    total, periods = sum(c.values()), sum(dots.values())
    scores = {}
    for w in dots:
        if w != "##number##" and regex.search(r"\p{L}", w):
            inner = w.count(".")
            ll = -2 * (binomial(dots[w], c[w], periods / total) - (dots[w] * math.log(0.99) + (c[w] - dots[w]) * math.log(0.01)))
            scores[w] = ll * math.exp(-(len(w) - inner)) * (inner + 1) * float(len(w) - inner) ** -(c[w] - dots[w])
    short = {w for w, s in scores.items() if s >= 0.3}
    initial = lambda w: bool(regex.match(r"\p{L}\Z", w))
    sure = lambda k, w: k == "hard" or not (w in short or initial(w) or w == "##number##")
    pairs = [p for p in pairs if p[2]]
    after = collections.Counter(n for k, w, n, _ in pairs if sure(k, w))
    ends = sum(after.values())
    starts = {w for w, n in after.items() if n * total > c[w] * ends and ends < total and ratio(ends, c[w], n, total) >= 30}
    across = collections.Counter((w, n) for k, w, n, _ in pairs if k == "dot" and (initial(w) or w == "##number##"))
    habit = {(w, n) for (w, n), x in across.items() if x > 1 and n not in starts and x * total > c[w] * c[n] and c[w] < total and ratio(c[w], c[n], x, total) >= 7.88}
    places = []
    for i, r in enumerate(rows):
        for at, ((k, w, _), (_, n, u)) in enumerate(zip(r, r[1:], strict=False)):
            if not k:
                continue
            final = u and ((lower[n] > 0 and upper[n] - begun[n] == 0) or n in starts)
            if not n or sure(k, w):
                end = True
            elif w in short and not initial(w):
                end = final
            else:
                end = not ((w, n) in habit or not u or (initial(w) and u and lower[n] == 0 and not final))
            if end:
                places.append((i, at))
    return short, starts, sorted(places)


def learned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kinds = N.types(N.facts(docs))
    scored = N.abbreviations(kinds)
    short = {r.w for r in scored.collect() if r.score >= N.ABBREVIATION}
    starts = {r.w for r in N.starters(kinds, N._pairs(N.facts(docs), scored)).collect()}
    joined = N.learn(docs)
    return docs, joined, short, starts, sorted((r.doc_id, r.pos) for r in N.ends(docs, joined).collect())


WORDS = ["Dr.", "dr.", "prof.", "itd.", "np.", "Nowak", "nowak", "Kowalski", "K.", "k.", "A.", "8.", "8.30.", "1995.", "kot", "Kot", "pies", "Pies", "dom.", "Dom", "The", "the", "to.", "To", "jest", "był!", "Co?", "«tak.»", "(nie.)", "z.b.", "...", "-", "e.g.", "ma", "Ma", "ale"]


def test_learned_ends_equal_plain_python(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS, weights=[9, 3, 8, 8, 9, 6, 1, 5, 4, 1, 4, 5, 2, 3, 9, 2, 9, 2, 6, 1, 4, 9, 6, 3, 9, 4, 4, 2, 2, 4, 1, 1, 5, 9, 1, 9], k=rng.randint(0, 60))) for _ in range(80)] + ["", " ", "Koniec."]
    _, _, short, starts, places = learned(spark, texts)
    expected = brute(texts)
    assert short == expected[0] and starts == expected[1] and places == expected[2]
    assert {"prof", "np"} & short and len(places) > 100


def test_an_abbreviation_ends_no_sentence(spark):
    rng = random.Random(12)
    verbs, places = ["przyjechał", "wyszedł", "zaspał", "zaczął"], ["rano", "wczoraj", "późno", "o ósmej"]
    texts = [" ".join(f"Dr hab. Nowak {rng.choice(verbs)} {rng.choice(places)}. Spotkanie {rng.choice(places)} {rng.choice(verbs)} się {rng.choice(places)}." for _ in range(5)) for _ in range(60)]
    text = "Dr hab. Nowak przyjechał rano. Spotkanie zaczęło się punktualnie."
    docs, joined, short, _, _ = learned(spark, [*texts, text, None])
    assert "hab" in short
    got = {r.doc_id: r.sentences for r in N.split(docs, joined).collect()}
    assert got[60] == ["Dr hab. Nowak przyjechał rano.", "Spotkanie zaczęło się punktualnie."] and got[61] == []
    assert len(got[0]) == 10
    assert N.learn(docs.where("false")).count() == 0


def test_scores_of_hot_types_need_no_group_of_rows(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the cat. The dog.").alias("text"))
    counts = {(r.what, r.w, r.next, r.upper): r.c for r in N.facts(docs).collect()}
    assert counts["word", "cat", ".", False] == 2000 and counts["dot", "cat", "the", True] == 2000 and counts["start", "", "the", False] == 2000
