import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomtext.functions import cleaning as C, similarity as S, stemming, text as X
from loomtext.operators import profile as P
from loomtext.operators.ranking import keep_first, ranked
from loomtext.operators.tokens import apply_bpe, merge_pair, train_bpe


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_prices(spark):
    got = values(spark, C.price, "1 201,35 zł", "$1,234.56", "1.234,56 €", None, "brak")
    assert [tuple(x) for x in got] == [(1201.35, "PLN"), (1234.56, "USD"), (1234.56, "EUR"), (None, None), (None, None)]


def test_v2_prices_reject_two_dots(spark):
    assert [tuple(x) for x in values(spark, C.price_in_pln, "100,00 €", "1.234,56 €", "")] == [(100.0, "EUR", 430.0), (None, "EUR", None), (None, None, None)]


def test_stemmers():
    words = "borrower edge husbandry philosophy lady why increase fortune outrageous troubles".split()
    assert [stemming.porter(w) for w in words] == "borrow edg husbandri philosophi ladi whi increas fortun outrag troubl".split()
    assert [stemming.snowball_english(w) for w in ("simulating", "annealing", "generously", "algorithms")] == ["simul", "anneal", "generous", "algorithm"]


@given(st.text("abc ", max_size=8), st.text("abc ", max_size=8))
@settings(max_examples=60, deadline=None)
def test_edit_script_rebuilds_the_text(a, b):
    script = S.edit_script(a, b)
    assert "".join(x for _, x, _ in script) == a and "".join(y for _, _, y in script) == b
    assert sum(o != "match" for o, _, _ in script) == S._distances(a, b)[-1][-1] >= S.damerau(a, b)


def test_bpe_toy_corpus(spark):
    words = spark.createDataFrame([("kot", 5), ("kota", 4), ("kotek", 3), ("koty", 2)], "word string, c int")
    merges = train_bpe(words, 2)
    assert merges[0] == ("k", "o") and merge_pair(("k", "o", "t"), merges[0]) == ("ko", "t")
    assert apply_bpe(words.limit(1), "word", merges).first()["pieces"] == ["kot"]


def test_ngrams_of_short_lists(spark):
    df = spark.createDataFrame([(["Ala", "ma", "kota"],)], "t array<string>")
    assert [len(df.select(X.ngrams(F.col("t"), n)).first()[0]) for n in (1, 2, 3, 4)] == [3, 2, 1, 0]


def test_mode_takes_the_least_of_a_tie(spark):
    df = spark.createDataFrame([(4.0,), (2.0,), (4.0,), (2.0,), (None,)], "x double")
    row = P.describe(df, ["x"]).first()
    assert (row["mode"], row["missing"], row["n"]) == (2.0, 1, 4)


def test_ranked_is_a_global_row_number(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 37 % 1000))
    rows = ranked(df.repartition(7), ["k"]).collect()
    assert len(rows) == 1000 and all(r["rank"] == r["k"] + 1 for r in rows)
    assert sorted(r["rank"] for r in ranked(df.withColumn("k", F.lit(1)), [-F.col("k")]).collect()) == list(range(1, 1001))
    assert ranked(df.where("false"), ["k"]).count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (1, 2), (3, 3), (2, 4)], "id int, i int")
    assert sorted((r["id"], r["i"]) for r in keep_first(df, "id", ["i"]).collect()) == [(1, 0), (2, 1), (3, 3)]
