"""Treebank tokens: known values, the rules in plain Python, and the way back."""

import random
import re

from pyspark.sql import functions as F

from loomtext.functions import treebank as B

KNOWN = {
    "They'll save and invest more.": ["They", "'ll", "save", "and", "invest", "more", "."],
    "hi, my name can't hello,": ["hi", ",", "my", "name", "ca", "n't", "hello", ","],
    "Good muffins cost $3.88 in New York (roughly 3,36 euros).": ["Good", "muffins", "cost", "$", "3.88", "in", "New", "York", "(", "roughly", "3,36", "euros", ")", "."],
    'He said "no" twice... 50% of it -- I cannot.': ["He", "said", "``", "no", "''", "twice", "...", "50", "%", "of", "it", "--", "I", "can", "not", "."],
    "'Tis John's dog; isn't it?": ["'T", "is", "John", "'s", "dog", ";", "is", "n't", "it", "?"],
}


def plain(sentence):
    for pattern, by in B.RULES:
        sentence = re.sub(pattern.replace(r"\z", r"\Z"), re.sub(r"\$(\d)", r"\\g<\1>", by), sentence)
    return sentence.split()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, s string")


def test_known_sentences(spark):
    got = {r.s: r.t for r in frame(spark, [*KNOWN, "", None]).select("s", B.tokens(F.col("s")).alias("t")).collect()}
    assert got == KNOWN | {"": [], None: []}
    whole = frame(spark, ["It's so. Isn't it? Yes.\nNo", None]).select(B.text_tokens(F.col("s")).alias("t")).collect()
    assert [r.t for r in whole] == [["It", "'s", "so", ".", "Is", "n't", "it", "?", "Yes", ".", "No"], []]


def test_random_texts_equal_the_rules_in_python(spark):
    rng = random.Random(41)
    signs = ["a", "Kot", "n't", "'s", "'", '"', "``", ".", "..", ",", ":", "3", "$", "(", ")", "<", "-", "--", "cannot", "gonna", "'Tis", "?", "&", " ", " ", " "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(3000)]
    for r in frame(spark, texts).select("s", B.tokens(F.col("s")).alias("t")).collect():
        assert r.t == plain(r.s), r.s


def sentence(rng, depth=0):
    words = ["Anna's", "dog", "can't", "we'll", "cannot", "gonna", "they've", "3.88", "1,200", "I'm", "e.g.", "no", "well--known", "U.S.", "'Twas", "gotta", "Wanna", "lemme"]
    out = rng.choices(words, k=rng.randint(1, 6))
    if depth < 2 and rng.random() < 0.5:
        inner = sentence(rng, depth + 1)
        out.append(rng.choice([f'"{inner}"', f"({inner})", f"[{inner}]", f"costs $5", f"{inner}, yes", f"{inner};"]))
    return " ".join(out)


def test_the_way_back(spark):
    rng = random.Random(42)
    texts = [sentence(rng) + rng.choice([".", "?", "!", ""]) for _ in range(1500)]
    for r in frame(spark, texts).select("s", B.joined(B.tokens(F.col("s"))).alias("b"), B.tokens(F.col("s")).alias("t")).collect():
        assert r.b == r.s, r.t


def test_rendering(spark):
    rows = [["ala", ",", "kot", "(", "pies", ")", "!", "?", "</s>", "</s>", "„", "nie", "”", "."], ["</s>"], [], ["a", "</s>", "b"]]
    got = [r.b for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "i int, t array<string>").orderBy("i").select(B.rendered_units(F.col("t"), "</s>").alias("b")).collect()]
    assert got == ["ala, kot (pies)!?\n„nie”.", "", "", "a\nb"]
