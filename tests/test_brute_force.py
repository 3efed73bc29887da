"""Operators without SQL, and those by counts in ranges, against plain Python."""

import collections
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loomtext.functions import stemming
from loomtext.operators import lm as L, profile as P, sentences as N, tokens as T, vectors as V
from loomtext.plans import catalogue, learning, search, text
from loomtext.streaming import limits

SF = "/root/testdata/sf0.001"


def test_quantiles_ranks_and_medians(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)]) if k % 3 else rng.random()) for k in range(700)] + [("c", None), ("d", 2.0)]
    rows = [(g, None if x is None else float(x)) for g, x in rows]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.low, r.mid) for r in P.quantiles(df, "x", {"low": 0.25, "mid": 0.5}, "g").collect()}
    of = {g: [x for k, x in rows if k == g and x is not None] for g in "abd"}
    assert got == {g: pytest.approx(tuple(np.quantile(of[g], [0.25, 0.5]))) for g in "abd"}
    every = sorted(x for _, x in rows if x is not None)
    assert P.upper_median(df, "x").first()[0] == every[len(every) // 2]
    place = collections.defaultdict(list)
    for k, x in enumerate(every, 1):
        place[x].append(k)
    ranks = {r.value: r.rank for r in P.average_rank(df.where("x is not null"), "x").collect()}
    assert ranks == {x: sum(k) / len(k) for x, k in place.items()}


def test_merges_equal_one_by_one(spark):
    rng = random.Random(1)
    words = collections.Counter("".join(rng.choices("abcde", [5, 4, 3, 2, 1], k=rng.randint(1, 9))) for _ in range(300))
    corpus, expected = {tuple(w): c for w, c in words.items()}, []
    for _ in range(8):
        pairs = collections.Counter()
        for w, n in corpus.items():
            for pair in zip(w, w[1:], strict=False):
                pairs[pair] += n
        expected.append(min(pairs, key=lambda p: (-pairs[p], p)))
        merged = collections.Counter()
        for w, n in corpus.items():
            merged[T.merge_pair(w, expected[-1])] += n
        corpus = merged
    assert T.train_bpe(spark.createDataFrame(list(words.items()), "word string, c int"), 8) == expected


def test_generated_texts_follow_the_model(spark):
    rng = random.Random(2)
    sentences = [(k, rng.choices("abcd", [4, 3, 2, 1], k=rng.randint(1, 6))) for k in range(60)]
    got = collections.defaultdict(list)
    for r in L.generate(spark.createDataFrame(sentences, "sid long, t array<string>"), 2, 12, 5, seed=9).orderBy("text", "pos").collect():
        got[r.text].append(r.w)
    counts = collections.defaultdict(collections.Counter)
    for _, t in sentences:
        for a, b in zip([L.BOS, *t], [*t, L.EOS], strict=True):
            counts[a][b] += 1
    for k in range(12):
        out, now = [], L.BOS
        for pos in range(5):
            u = int(hashlib.md5(f"9|{k}|{pos}".encode()).hexdigest()[:8], 16) / (1 << 32)
            total, upto = sum(counts[now].values()), 0
            for w, c in sorted(counts[now].items()):
                upto += c
                if u < upto / total:
                    break
            if w == L.EOS:
                break
            out.append(w)
            now = w
        assert got[k] == out


def test_nearest_rows(spark):
    rng = np.random.default_rng(5)
    vecs = rng.integers(0, 3, (300, 4)).astype(float)  # many ties
    rows = [(k, int(k % 3), v.tolist()) for k, v in enumerate(vecs)]
    train = spark.createDataFrame(rows, "id long, label int, vec array<double>").repartition(5)
    queries = train.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    got = sorted((r["query"], r["rank"], r["id"]) for r in V.nearest(train, queries, 5).collect())
    expected = []
    for q in range(0, 300, 20):
        near = sorted((np.sqrt(((vecs[q] - vecs[i]) ** 2).sum()), i) for i in range(300) if i != q)[:5]
        expected += [(q, k, i) for k, (_, i) in enumerate(near, 1)]
    assert got == sorted(expected)


def test_first_sentence_with_phrases_of_any_length(spark):
    rng = random.Random(6)
    lines = [(d, p, " ".join("".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(rng.randint(0, 6)))) for d in range(40) for p in range(3)]
    phrases = sorted({t[a : a + n] for _, _, t in lines for a in range(0, len(t), 3) for n in (0, 1, 2, 3, 5, 8)} | {"zz", "zz a zz"})
    got = {r.phrase: r.sentence for r in T.first_sentence_with(spark.createDataFrame(lines, "doc_id int, pos int, sentence string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    first = {p: next((t for _, _, t in lines if p in t), None) for p in phrases}
    assert got == {p: t for p, t in first.items() if t is not None}


def test_phrases_of_all_lengths_meet_the_sentences_in_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, 0, "xa b c"), (2, 0, "a  b ccc d"), (3, 0, "a b c d")], "doc_id int, pos int, sentence string").write.parquet(f"{tmp_path}/lines")
    phrases = spark.createDataFrame([(p,) for p in ("a", "b c", "ccc", "a b c", "a  b c", "b ccc d", "a b c d", "a d")], "phrase string")
    found = T.first_sentence_with(spark.read.parquet(f"{tmp_path}/lines"), phrases)
    assert found._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/lines") == 1
    assert {r.phrase: r.sentence for r in found.collect()} == {"a": "xa b c", "b c": "xa b c", "ccc": "a  b ccc d", "a b c": "xa b c", "a  b c": "a  b ccc d", "b ccc d": "a  b ccc d", "a b c d": "a b c d"}


def test_streamed_limits_forget_idle_clients(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(4)
    rows = sorted((rng.randint(0, 20_000), rng.choice([1, 1, 1, 2, 3]), k) for k in range(400))
    for part in range(4):
        some = [(k, c, t) for t, c, k in rows[part * 100 : part * 100 + 100]]
        spark.createDataFrame(some, "event long, client long, t long").select("event", "client", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("event long, client long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    query = limits.rate_limit_stream(stream, "client", "ts", "event", 2, 600.0, "10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event: r.accepted for r in spark.read.parquet(out).collect()}
    kept, expected = collections.defaultdict(list), {}
    for t, c, k in sorted(rows, key=lambda r: (r[0], r[2])):
        decision, kept[c] = limits.accept([float(t)], kept[c], 2, 600.0)
        expected[k] = decision[0]
    assert got == expected


def test_hash_sample(spark):
    got = {r[0] for r in catalogue.hash_sample(spark, SF).collect()}
    ids = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert got == set(sorted(ids, key=lambda i: (zlib.crc32(str(i).encode()), i))[: len(got)])


def test_unicode_forms_and_proper_names(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in text.unicode_forms(spark, SF).collect():
        c, d = (unicodedata.normalize(f, rows[r.doc_id]) for f in ("NFC", "NFD"))
        assert (r.composed, r.decomposed, r.equal) == (len(c), len(d), c == d)
    names = collections.Counter(x for t in rows.values() for x in regex.findall(r"(?<=[\p{L}\p{N}_,;:] )\p{Lu}\p{Ll}+", t))
    assert {r.name: r.c for r in text.proper_names(spark, SF).collect()} == dict(names)


def vocabulary():
    import pyarrow.parquet as pq

    return {w for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() for w in regex.sub(r"\s+", " ", regex.sub(r"[^\p{L}\p{N}_\s]", "", t or "").lower()).split(" ") if w}


def test_stem_table_lists_the_words_with_different_stems(spark):
    got = {r.w: (r.porter, r.snowball) for r in text.stem_table(spark, SF).collect()}
    assert got == {w: (p, s) for w in vocabulary() if (p := stemming.porter(w)) != (s := stemming.snowball_english(w))}


def test_over_and_under_stemming(spark):
    lemma = {w: regex.sub("(s|ed|ing)$", "", w) for w in vocabulary()}
    stems, lemmas = collections.defaultdict(set), collections.defaultdict(set)
    for w, x in lemma.items():
        stems[stemming.porter(w)].add(x)
        lemmas[x].add(stemming.porter(w))
    over = {("over", k, len(v)) for k, v in stems.items() if len(v) > 1 and not any(a != b and b.startswith(a) for a in v for b in v)}
    under = {("under", k, len(v)) for k, v in lemmas.items() if len(v) > 1}
    assert {tuple(r) for r in text.over_and_under_stemming(spark, SF).collect()} == over | under


def test_classifiers_count_the_whole_test_split(spark):
    sizes = {r.quality: r.n for r in learning.split_sizes(spark, SF).where("split = 'test'").collect()}
    for r in learning.classifier_table(spark, SF).collect():
        assert (r.tn + r.fp, r.fn + r.tp) == (sizes.get(0, 0), sizes.get(1, 0)) and r.accuracy == pytest.approx((r.tn + r.tp) / sum(sizes.values()))


def test_classifiers_learn_from_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(learning, "_CELLS", 60_000)
    rows = spark.range(1200).select(F.col("id").alias("doc_id"))
    sizes = [len(p) for p in learning._bounded(rows, 600).rdd.glom().collect()]
    assert sum(sizes) == 1200 and len(sizes) == 12 and max(sizes) * 600 < 2 * 60_000
    before = {r.classifier: r for r in learning.classifier_table(spark, SF).collect()}
    monkeypatch.setattr(learning, "_CELLS", 10**9)
    after = {r.classifier: r for r in learning.classifier_table(spark, SF).collect()}
    assert before["DecisionTree"] == after["DecisionTree"] and before["LogisticRegression"] == after["LogisticRegression"]


def test_feature_weights_are_the_ends_of_the_same_model(spark):
    rows = learning.feature_weights(spark, SF).collect()
    top, low = rows[:10], rows[10:]
    assert [(-r.weight, r.term) for r in top] == sorted((-r.weight, r.term) for r in top) and [(r.weight, r.term) for r in low] == sorted((r.weight, r.term) for r in low)
    assert min(r.weight for r in top) > 0 > max(r.weight for r in low)


def test_highlights_mark_the_words_of_the_best_documents(spark):
    best = {r.doc_id for r in search.bm25_top10(spark, SF).collect()}
    got = search.highlighted_hits(spark, SF).collect()
    assert {r.doc_id for r in got} == best and all("<em>" in r.fragment for r in got)


def test_opinions_beyond_a_million(spark, tmp_path):
    rows = [(k, 12) for k in (3, 8997, 998997, 1000005, 123456789)]
    spark.createDataFrame(rows, "p_partkey long, p_size long").where("p_partkey % 6 = 3").write.parquet(f"{tmp_path}/part.parquet")
    for r in catalogue.clean_numbers(spark, str(tmp_path)).collect():
        assert (r.number, r.whole, r.kg) == (float((1000 + r.p_partkey) // 1000), str(1000 + r.p_partkey), None)


def test_word_vectors_learn_in_parts(spark, monkeypatch):
    assert [learning._learners(mb << 20, 12) for mb in (1, 16, 100, 1000, 6000)] == [1, 2, 12, 31, 187]
    monkeypatch.setattr(learning, "_LEARNER", 256 << 10)
    got = learning.word_vectors(spark, SF).collect()
    assert len(got) == learning._split(spark, SF).count() and all(len(r.vector) == 16 for r in got)


def test_term_counts_of_dealt_documents_are_not_shuffled(spark):
    plan = V.term_counts(learning._dealt(spark, SF), "doc_id", F.col("tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    dealt = spark.range(20).select(F.col("id").alias("doc_id"), F.array(F.lit("a"), F.lit("b")).alias("t")).repartition(3, "doc_id")
    counted = V.term_counts(dealt, "doc_id", F.col("t"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and counted.count() == 40


def test_rules_and_words_are_applied_once_for_each_row(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (text.rejoined_sentences(spark, SF), text._vocabulary(spark, SF)):
        assert not any("Filter" in line.split("(")[0] and "regexp_replace" in line for line in plan(df).splitlines())
    assert plan(N.facts(spark.createDataFrame([("a b. C", )], "text string"))).count("Aggregate") == 2
