"""TF-IDF against plain Python, on odd rows, and what its plan does to the rows of documents and terms."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from loomtext.operators import vectors as V
from loomtext.plans import learning

SF = "/root/testdata/sf0.001"


def _weights(docs: dict[int, list[str]], most: int) -> dict[tuple[int, str], float]:
    """tf-idf of each document's terms, by the formulas."""
    tf, cf = {k: Counter(ts) for k, ts in docs.items() if ts}, Counter(t for ts in docs.values() for t in ts)
    df = Counter(t for c in tf.values() for t in c)
    kept = sorted((t for t in cf if df[t] > 1), key=lambda t: (-cf[t], t.encode()))[:most]
    x = {k: {t: c[t] * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t in kept if t in c} for k, c in tf.items()}
    return {(k, t): round(v / math.sqrt(sum(u * u for u in w.values())), 6) for k, w in x.items() for t, v in w.items()}


def _runs(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w)) for n in (3, 4, 5) if i + n <= len(w)]


def test_weights_of_words_and_letter_runs_on_odd_rows(spark, tmp_path):
    many = " ".join(f"{'ab' * (k % 9)}{k}" for k in range(60_000))  # over a part of the units that are spelled at once
    rows = [(1, "aa bb aa"), (2, "bb żółć\tżółw"), (2, "aa żółć"), (3, None), (4, " .\n "), (5, "unique"), (6, "𝒳y𝒳zz 日本語日本語 aa"), (7, "aa bb"), (8, "日本語 y𝒳zz"), (9, many), (10, "9 " + "long" * 2000), (11, "x" * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, None if k == 2 else k % 2) for k in (*range(1, 7), *range(8, 15), 6)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    words: dict[int, list[list[str]]] = {}
    for k, text in rows:
        words.setdefault(k, []).extend([re.findall(r"\w+", text or "")] * [x for x, _ in labels].count(k))
    for query, terms in (
        (learning.char_tf_idf, lambda text: [r for w in text for r in _runs(w)]),
        (learning.word_tf_idf, lambda text: text + [" ".join(p) for p in zip(text, text[1:])]),
    ):
        got = {(r["doc_id"], r["term"]): r["weight"] for r in query(spark, str(tmp_path)).collect()}
        expected = _weights({k: [t for text in texts for t in terms(text)] for k, texts in words.items()}, 50_000)
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-6 for k in got)


def test_only_the_most_frequent_terms_are_kept(spark):
    docs = {k: [f"t{k * j % 17}" for j in range(k % 5 * 3)] for k in range(40)}
    df = spark.createDataFrame(list(docs.items()), "k long, u array<string>").repartition(3, "k")
    for most in (0, 1, 7, 100):
        got = {(r["k"], r["term"]): r["weight"] for r in V.tf_idf(df, "k", F.col("u"), max_features=most).collect()}
        expected = _weights(docs, most)
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-6 for k in got)


def test_weights_of_terms_are_neither_joined_nor_shuffled(spark):
    for query in (learning.char_tf_idf, learning.word_tf_idf):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and not any(x in plan for x in ("Join", "Exchange", "Aggregate"))


def test_letter_runs_are_made_once_for_equal_words_of_a_batch(spark):
    spelled = spark.sparkContext.accumulator(0)

    def runs(words):
        spelled.add(len(words))
        return V.letter_runs(words)

    text = F.split(F.repeat(F.lit("some words again "), 100), " ")
    docs = spark.range(3000).select("id", F.filter(text, lambda w: w != "").alias("u")).repartition(2, "id")
    assert V.tf_idf(docs, "id", F.col("u"), runs).count() == 3000 * len({r for w in ("some", "words", "again") for r in _runs(w)})
    assert 0 < spelled.value < 100
