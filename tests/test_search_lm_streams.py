import json

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import lm as L, search as S, vectors as V
from loomtext.sources import files
from loomtext.streaming import limits

TRAIN = [(1, "ala ma kota"), (2, "kot ma ale"), (3, "ala ma psa i kota"), (4, "pies ma ale")]


def sentences(spark, rows):
    return spark.createDataFrame(rows, "sid int, x string").select("sid", F.split("x", " ").alias("t"))


def test_bigram_probabilities(spark):
    scored = {(r["i"], r["w"]): r["p"] for r in L.score(sentences(spark, TRAIN), sentences(spark, [(9, "ala ma kota")]), 2, "mle").collect()}
    assert scored[4, "kota"] == pytest.approx(0.25)


@pytest.mark.parametrize("method", ["mle", "laplace", "kn"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_distributions_sum_to_one(spark, method, n):
    train = sentences(spark, TRAIN)
    words = [r["w"] for r in L.counts(train, 1).select("w").distinct().collect() if r["w"] != L.EOS]
    test = sentences(spark, [(k, f"ala ma {w}") for k, w in enumerate(words)])
    rows = L.score(train, test, n, method).where(f"i = {n + 2}").collect()
    end = L.score(train, sentences(spark, [(0, "ala ma")]), n, method).where(f"i = {n + 2}").collect()
    assert sum(r["p"] for r in rows + end) == pytest.approx(1.0, abs=1e-9)


def test_perplexity_is_infinite_without_smoothing(spark):
    test = sentences(spark, [(1, "kot ma kota"), (2, "ala i")])
    assert L.perplexity(L.score(sentences(spark, TRAIN), test, 2, "mle")).first()["perplexity"] == float("inf")
    assert L.perplexity(L.score(sentences(spark, TRAIN), test, 2, "kn")).first()["perplexity"] < float("inf")


def test_phrases_do_not_cross_fields(spark):
    docs = spark.createDataFrame([(1, "neural", "network models"), (2, "x", "a neural network")], "doc_id int, title string, body string")
    found = S.search(S.in_memory(S.postings(docs, ("title", "body"))), S.Phrase(("neural", "network")))
    assert [r["doc_id"] for r in found.collect()] == [2]


def test_rejected_requests_do_not_count():
    decisions, kept = limits.accept([0, 0.1, 0.2, 1.9, 2.0, 2.1], [], 2, 2.0)
    assert decisions == [True, True, False, False, True, True] and kept == [2.0, 2.1]


def test_batch_limits(spark):
    log = spark.createDataFrame([(1, i, i * 0.5) for i in range(8)], "c int, e int, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event"]: r["accepted"] for r in limits.rate_limited(log, "c", "ts", "e", 2, 2.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_mean_vectors_and_coverage(spark):
    tokens = spark.createDataFrame([(1, "good"), (1, "excellent"), (2, "missing")], "d int, w string")
    vectors = spark.createDataFrame([("good", [1.0, 0.0, 0.0]), ("excellent", [0.0, 0.0, 1.0])], "w string, vec array<double>")
    got = {r["d"]: (r["vector"], r["known"]) for r in V.mean_vectors(tokens, vectors, "d", 3).collect()}
    assert got == {1: ([0.5, 0.0, 0.5], 2), 2: ([0.0, 0.0, 0.0], 0)}


def test_stratified_split(spark):
    df = spark.range(3100).withColumn("label", (F.col("id") % 2).cast("int"))
    n = {(r["label"], r["split"]): r["count"] for r in V.stratified_split(df, "label", F.md5(F.col("id").cast("string"))).groupBy("label", "split").count().collect()}
    assert n == {(0, "train"): 1240, (0, "test"): 310, (1, "train"): 1240, (1, "test"): 310}


def test_envelope_csv_and_markdown(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"liczba_rekordow": 2, "produkty": [{"id": 1, "n": "ż"}, {"id": 2}]}), encoding="utf-8")
    df = files.first_readable(spark, [str(tmp_path / "none.json"), str(p)], "produkty")
    assert sorted(r["id"] for r in df.collect()) == [1, 2]
    files.write_csv(df, str(tmp_path / "csv"), ";")
    assert files.read_csv(spark, str(tmp_path / "csv"), df.schema, ";").count() == 2
    assert files.markdown(df.orderBy("id")).splitlines()[2] == "| 1 | ż |"


def test_embedding_subset_checks_the_width(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 2\nb 1 2 3\n")
    words = spark.createDataFrame([("a",)], "word string")
    assert files.read_embeddings(spark, str(tmp_path / "v.txt"), words, 2).first()["vec"] == [1.0, 2.0]
    with pytest.raises(Exception, match="wrong width"):
        files.read_embeddings(spark, str(tmp_path / "v.txt"), spark.createDataFrame([("b",)], "word string"), 2).collect()


def test_fuzzy_search_uses_every_term(spark):
    index = spark.range(110_000).select(F.lpad(F.lower(F.hex("id")), 5, "0").alias("term"), F.col("id").alias("doc_id"))
    index = index.unionAll(spark.createDataFrame([("zzzzzzzzzzz", 110_000), (None, 110_001), ("zz", 110_002)], "term string, doc_id long"))
    index = S.in_memory(index.withColumns({"field": F.lit("t"), "pos": F.lit(0)}))
    got = S.fuzzy_search(index, "zzzzz", 5)
    assert got.agg(F.count("*"), F.sum("doc_id")).first()[:] == (110_001, sum(range(110_000)) + 110_002)


def test_search_equals_a_scan_of_words(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices("abcdefg", k=rng.randint(0, 12)))) for k in range(300)]
    index = S.in_memory(S.postings(spark.createDataFrame(rows, "doc_id int, t string"), ("t",)))
    has = lambda t, *w: any(t.split()[i : i + len(w)] == list(w) for i in range(len(t.split())))
    for query, wanted in [
        (S.Phrase(("b", "c", "b")), lambda t: has(t, "b", "c", "b")), (S.Phrase(("d", "d")), lambda t: has(t, "d", "d")), (S.Or((S.Term("b"), S.Phrase(("c", "d")))), lambda t: has(t, "b") or has(t, "c", "d")),
        (S.And((S.Or((S.Term("b"), S.Term("c"))), S.Phrase(("d", "e")), S.Not(S.Term("f")))), lambda t: (has(t, "b") or has(t, "c")) and has(t, "d", "e") and not has(t, "f")),
    ]:
        assert sorted(r.doc_id for r in S.search(index, query).collect()) == [k for k, t in rows if wanted(t)]


def test_cover_density_of_several_words(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices("bcdefgh", k=rng.randint(0, 14)))) for k in range(200)]
    index = S.in_memory(S.postings(spark.createDataFrame(rows, "doc_id int, t string"), ("t",)))
    got = {r.doc_id: r.score for r in S.cover_density(index, ("b", "c", "d"), {"t": 0.4}).collect()}
    expected = {}
    for k, text in rows:
        w = text.split()
        covers = [(i, j) for i in range(len(w)) for j in range(i, len(w)) if {"b", "c", "d"} <= set(w[i : j + 1]) and not {"b", "c", "d"} <= set(w[i + 1 : j + 1]) and not {"b", "c", "d"} <= set(w[i:j])]
        if covers:
            expected[k] = sum(0.4 / (1 + max(0, j - i + 1 - 3)) for i, j in covers)
    assert got == pytest.approx(expected)


def test_an_index_is_made_once_for_each_version_of_a_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    make = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string").write.mode("overwrite").parquet(path)
    find = lambda: sorted(r.doc_id for r in S.search(S.stored(spark.read.parquet(path), path, ("t",), "t"), S.Term("x")).collect())
    make(["x y", "y", "x"])
    before = len(spark.sparkContext.__dict__.get("_loomtext_kept", {}))
    assert find() == find() == [0, 2] and len(spark.sparkContext._loomtext_kept) == before + 1
    make(["y", "x"])
    assert find() == [1] and len(spark.sparkContext._loomtext_kept) == before + 2


def test_a_term_that_stands_everywhere_is_spread_over_files(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot "), F.col("id").cast("string")).alias("t")).write.parquet(path)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        index = S.stored(spark.read.parquet(path), path, ("t",), "hot")
    finally:
        spark.conf.set(key, before)
    files = index.postings.where("term = 'hot'").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 4000
    assert S.search(index, S.Term("hot")).count() == 4000 and [r.doc_id for r in S.search(index, S.Term("17")).collect()] == [17]


def test_postings_by_document_are_those_by_places(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "b", "the", "Żó", "x1", "b b", ",", "of", "cc"]) for _ in range(rng.randrange(n)))
    rows = [(k if k % 9 else 3, text(6), None if k % 7 == 0 else text(60)) for k in range(120)] + [(None, "a b", "a"), (500, "", ""), (501, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    fields = ("title", "body")
    got = S.by_document(docs, fields)
    assert sorted(map(tuple, got.select("term", "field", "doc_id", "pos", "dl").collect())) == sorted(map(tuple, S.grouped(S.postings(docs, fields)).collect()))
    heads = {tuple(r) for r in got.where("head").select("term", "doc_id").collect()}
    assert got.where("head").count() == len(heads) == got.select("term", "doc_id").distinct().count()
    # places are gathered inside a document: nothing but keys is shuffled
    plan = got._jdf.queryExecution().executedPlan().toString()
    unique = S.by_document(docs.where("doc_id > 3 and doc_id % 9 <> 0"), fields)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in unique


def test_phrase_with_a_word_twice_by_places(spark):
    rows = [(1, "er th er"), (2, "er er th"), (3, "th er er"), (3, "er th er th")]
    index = S.in_memory(S.postings(spark.createDataFrame(rows, "doc_id int, t string"), ("t",)))
    assert sorted(r[0] for r in S.search(index, S.Phrase(("er", "th", "er"))).collect()) == [1, 3]
    assert sorted(r[0] for r in S.search(index, S.Phrase(("er", "er", "th"))).collect()) == [2, 3]


def test_longest_copied_run_is_found_by_one_length_at_a_time(spark, monkeypatch):
    rng, asked, grams = random.Random(11), [], L.grams
    monkeypatch.setattr(L, "grams", lambda units, n: asked.append(n) or grams(units, n))
    source = [" ".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(6)]
    for text in [*(" ".join(rng.choices("abc", k=k)) for k in (1, 4, 15)), source[0] + " z", "z", "a z b"]:
        own = text.split()
        runs = {n: {tuple(w[i : i + n]) for w in map(str.split, source) for i in range(len(w) - n + 1)} for n in range(1, 13)}
        longest = max((n for n in runs if any(tuple(own[i : i + n]) in runs[n] for i in range(len(own) - n + 1))), default=0)
        asked.clear()
        found = L.longest_copied(sentences(spark, [(1, text)]), sentences(spark, list(enumerate(source))))
        assert found.dtypes == [("longest", "int")] and found.first()[0] == longest
        assert asked[:2] == [12, 12] and len(asked) <= 10 and (longest < 12 or len(asked) == 2)
