"""The byte-level trainer against the installed library's."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

from loomtext.operators import subwords as U
from loomtext.plans import text as plans

SF = "/root/testdata/sf0.001"


def library(texts, merges):
    t = Tokenizer(models.BPE(unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.decoder = decoders.ByteLevel()
    t.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=len(U.SPECIALS) + 256 + merges, min_frequency=2, special_tokens=list(U.SPECIALS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    model = json.loads(t.to_str())["model"]
    return t, [(model["vocab"][a], model["vocab"][b]) for a, b in model["merges"]]


def test_a_thousand_merges_of_documents(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer, expected = library(list(rows.values()), 1000)
    found = plans.byte_level_merges(spark, SF).orderBy("rank").collect()
    assert [(r["first"], r["second"]) for r in found] == expected
    got = {r.doc_id: (r.units, r.lossless) for r in plans.byte_level_units(spark, SF).collect()}
    assert got == {i: (len(tokenizer.encode(t).ids), True) for i, t in rows.items()}
    curve = {r.merges: r.units for r in plans.byte_level_curve(spark, SF).collect()}
    assert curve[1000] == sum(n for n, _ in got.values())
    assert curve[0] == sum(len(t.encode()) + (t[:1] not in ("", " ")) for t in rows.values())
    assert curve[0] > curve[250] > curve[500] > curve[1000]


@pytest.mark.parametrize(("leading", "segments"), [(256, 100_000), (4, 100_000), (256, 3), (1, 1)])
def test_rounds_of_any_size_find_the_same_merges(spark, monkeypatch, leading, segments):
    monkeypatch.setattr(U, "LEADING", leading)
    monkeypatch.setattr(U, "SEGMENTS", segments)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("aabcé", k=rng.randint(1, 9))) for _ in range(20)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [p for p, _ in U.train(U.piece_counts(docs), 12)]
    assert got == library(texts, 12)[1]


def test_units_give_any_text_back(spark):
    rng = random.Random(8)
    texts = ["", " ", "\n\n a", "it's we'll 'x", None, *("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0xE000, 0x1F9FF)])) for _ in range(rng.randint(0, 40))) for _ in range(100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    merges = [p for p, _ in U.train(U.piece_counts(docs), 20)]
    vocabulary = U.ByteVocabulary(merges)
    rows = U.encode(docs, vocabulary, prefix_space=False).withColumn("back", U.decode(F.col("ids"), vocabulary)).collect()
    assert all(r.back == (r.text or "") for r in rows) and len(rows) == len(texts)
    assert U.train(U.piece_counts(docs.where("false")), 5) == []


def test_a_batch_of_words_is_rewritten_at_once(spark):
    rng = random.Random(9)
    made, symbols = {}, list(range(70_000, 70_003)) + list(range(55_000, 55_003))
    for new in range(80_000, 80_030):
        made[rng.choice(symbols), rng.choice(symbols)] = new
        symbols.append(new)
    words = [rng.choices(symbols[:8], k=rng.randint(0, 9)) for _ in range(300)]
    expected = []
    for w in words:
        for pair, new in made.items():
            w = U.merged(w, pair, new)
        expected.append("".join(map(U.sign, w)))
    assert U.replaced("\n".join("".join(map(U.sign, w)) for w in words), made).split("\n") == expected
    weights = spark.createDataFrame([("aab", 1 << 40), ("ab", 3), ("", 5), ("ba", 1)], "piece string, c long")
    assert [n for _, n in U.train(weights, 2)] == [(1 << 40) + 3, 1 << 40]


def test_pieces_are_counted_once_for_each_version_of_the_table(spark):
    first = plans._byte_pieces(spark, SF)
    curve = plans.byte_level_curve(spark, SF)
    assert first.inputFiles() == plans._byte_pieces(spark, SF).inputFiles() and set(curve.inputFiles()) == set(first.inputFiles())


def test_texts_are_cut_as_the_pattern_says(spark, monkeypatch):
    rng = random.Random(10)
    letters = "'''  \n\tstmdrevlaé1٣!. ͅ ⅷ😀𝒳"
    texts = ["", " ", "'s", "it's'll 's  'd\n've!'t'", None, "x" * 5000, *("".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    monkeypatch.setattr(U, "_CUT", 200)
    kind_of = U.kinds(spark).value
    for prefix in (True, False):
        expected = [r.p for r in docs.select("i", U.pieces(F.coalesce("text", F.lit("")), prefix).alias("p")).orderBy("i").collect()]
        found, many = U.split(pa.array(["before", *texts, "after"])[1:-1], kind_of, prefix)
        assert many.tolist() == [len(e) for e in expected] and found.to_pylist() == [p for e in expected for p in e]
    bad = pa.array([b"a\xff b", b"c"]).view(pa.string())
    assert U.split(bad, kind_of)[0].to_pylist() == [" a", "�", " b", " c"]


def test_pieces_stay_inside_their_tasks(spark):
    """No row is made for each piece, and neither pieces nor units are looked up one by one."""
    docs = spark.createDataFrame([(1, "aab ab")], "i int, text string")
    vocabulary = U.ByteVocabulary([p for p, _ in U.train(U.piece_counts(docs), 2)])
    units = U.encode(docs, vocabulary)
    for frame in (U.piece_counts(docs), units.select(U.decode(F.col("ids"), vocabulary))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any(x in plan for x in ("Generate", "regexp", "transform("))
    odd = spark.createDataFrame([([1 << 20, -1, 70, None],), ([],), (None,)], "ids array<int>").select(U.decode(F.col("ids"), vocabulary).alias("t"))
    assert [r.t for r in odd.collect()] == [vocabulary.payloads[70].decode(), "", None]


def test_long_pieces_are_encoded_in_few_turns():
    made = {(1, 1): 3, (3, 3): 4, (1, 2): 5, (4, 1): 6}
    symbols = np.array([1] * 100_001 + [2, 2] + [1] * 3, np.int32)
    found, sizes = U.encoded(symbols, np.array([100_003, 0, 3]), U.Merges(made))
    assert found.tolist() == [4] * 25_000 + [5, 2] + [3, 1] and sizes.tolist() == [25_002, 0, 2]
    found, sizes = U.encoded(np.array([1, 1]), np.array([2]), U.Merges({}))
    assert found.tolist() == [1, 1] and sizes.tolist() == [2]
