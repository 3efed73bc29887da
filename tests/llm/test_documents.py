"""Operators over documents: brute-force results and edge cases on small tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, licences, materialise, mixing, ngram_join, quality, toxicity
from loomtext.llm._frames import table

SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one"), (6, "a b c d e f g h"), (7, "a b c d e f g h"), (None, "a b c d e f g h"), (8, "x" * 50_000), (9, "word " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "s", "extra", 1.0) for i, t in EDGES], "doc_id long, text string, source string, labels string, score double")


def empty(df):
    return df.where("false")


def components(rows, size, percent):
    sets = {}
    for k, text in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in sets], [len(sets[k]) for k in sets]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, docs, size, percent):
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    words = base[6][1].split()[:150]
    family = []
    for k in range(40):  # near copies with one to four edits: chains and near misses
        w = list(words)
        for e in range(k % 4 + 1):
            w[(k * 7 + e * 31) % len(w)] = f"edit{k}x{e}"
        family.append((10_000 + k, " ".join(w)))
    rows = base + family + [(20_000, ""), (20_001, None), (20_002, "two words"), (20_003, "Two Words")]
    got = {r.doc_id: r for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    comp, n = components([t for _, t in rows], size, percent)
    assert {i: got[i].component_id for i, _ in rows} == {i: rows[c][0] for (i, _), c in zip(rows, comp, strict=True)}
    assert {i: got[i].n_shingles for i, _ in rows} == {i: k for (i, _), k in zip(rows, n, strict=True)}


def test_jaccard_edges(spark, edges):
    got = ngram_join.jaccard_components(edges, 4, 85)
    assert got.count() == len(EDGES) and ngram_join.jaccard_components(empty(edges), 4, 85).count() == 0
    ids = {(r.doc_id, r.component_id) for r in got.collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (None, 6)} <= ids
    kept = ngram_join.one_of_each(edges, 4, 85)
    assert kept.columns == edges.columns and {6, 4} <= {r.doc_id for r in kept.collect()} and 7 not in {r.doc_id for r in kept.collect()}


def test_one_of_each_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    rows = [
        (1, text(1), "a"), (2, text(1), "b"), (2, text(2), "c"), (2, text(3), "d"), (2, text(3), "e"), (None, text(4), "f"), (None, text(5), "g"),
        (None, text(1), "h"), (None, text(5) + " more", "i"), (3, "short one", "j"), (3, "short one", "k"), (3, "short two", "l"), (None, "short", "m"), (None, "short", "n"), (4, None, "o"), (4, None, "q"), (None, "", "r"), (None, "", "s"), (None, text(4), "p"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _class string")
    got = ngram_join.one_of_each(frame, 5, 80)
    kept = [(r.doc_id, r.text, r._class) for r in got.collect()]
    assert got.columns == frame.columns and set(kept) <= set(rows)
    pairs = collections.Counter((i, t) for i, t, _ in kept)
    either = [k for k in pairs if k[0] is None and k[1] in (text(5), text(5) + " more")]
    assert len(either) == 1
    expected = collections.Counter([(1, text(1)), (2, text(2)), (2, text(3)), (None, text(4)), (3, "short one"), (3, "short two"), (None, "short"), (None, ""), (None, ""), (4, None)])
    assert pairs - collections.Counter(either) == expected
    assert ngram_join.one_of_each(empty(frame), 5, 80).count() == 0


def rarity_weights(items):
    """Weight of a shingle of five words, from how many of the items have it."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    total, seen = sum(1 for s in sets if s), collections.Counter(x for s in sets for x in s)
    return lambda x: round(8 * (1 + math.log((1 + total) / max(seen[x], 1)) / math.log(1 + total)))


def test_recall_of_edited_items_of_all_sizes(spark):
    """Items of 6 to 60 words that share common words and phrases, with one to six
    words changed: of windows whose weighted similarity is 0.8 or more all but 1 % are found."""
    rng = random.Random(5)
    stock = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(7)] for _ in range(4)]
    texts = []
    for k in range(120):
        own = [rng.choice([f"u{k}x{j}", f"c{rng.randint(0, 40)}"]) for j in range(rng.randint(6, 60))]
        if rng.random() < 0.5:
            own[3:3] = rng.choice(stock)
        texts.append(own)
    weight = rarity_weights(texts)
    bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rows, expected = [], set()
    for k, words in enumerate(texts):
        for edits in range(7):
            for _ in range(3):
                other = [*words]
                for at in rng.sample(range(len(other)), min(edits, len(other))):
                    other[at] = "changed"
                mine, theirs = bag(words), bag(other)
                common, both = (sum(weight(x) * n for x, n in c.items()) for c in (mine & theirs, mine | theirs))
                rows.append((len(rows), " ".join(["before", "it", *other, "after", "it"])))
                if common >= 0.8 * both:
                    expected.add((len(rows) - 1, k))
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert len(expected) > 400 and len(expected - got) <= len(expected) // 100


def test_decontamination_equals_brute_force(spark, docs):
    items = table(spark, SF, "benchmark")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    first = items.orderBy("item_id").first()
    w = first.text.split()
    edited = " ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]])
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900_000, "before it " + first.text + " after it"), (900_001, edited), (900_002, None), (900_003, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected, weight = set(), rarity_weights([split(r.text) for r in items.collect()])
    for r in items.collect():
        words = split(r.text)
        bag = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        for i, t in rows:
            g = [tuple(x) for x in zip(*(split(t)[k:] for k in range(5)))] if t else []
            n = len(words) - 4
            if any(x in bag for x in g):
                for a in range(len(g) - n + 1):
                    window = collections.Counter(g[a : a + n])
                    common, both = (sum(weight(x) * k for x, k in c.items()) for c in (bag & window, bag | window))
                    if common >= 0.8 * both:
                        expected.add((i, r.item_id))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, items).collect()}
    assert (900_000, first.item_id) in got and got == expected
    left = decontaminate.drop_contaminated(frame, items)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_decontamination_edges(spark, edges):
    items = spark.createDataFrame([(1, "one"), (2, ""), (3, None), (4, "a b c d e f g h"), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(edges, items).collect()}
    assert got == {(4, 1), (5, 1), (6, 4), (7, 4), (None, 4)}
    assert decontaminate.contaminated(edges, empty(items)).count() == 0 and decontaminate.contaminated(empty(edges), items).count() == 0
    assert decontaminate.drop_contaminated(edges, items).columns == edges.columns


def test_weights_do_not_depend_on_blocks_of_items(spark, monkeypatch):
    rng = np.random.default_rng(3)
    stock = [" ".join(f"s{k}x{j}" for j in range(12)) for k in range(6)]
    own = lambda k, n: " ".join(f"i{k}x{j}" for j in range(n))
    texts = [f"{stock[k % 2]} {own(k, 20)} {stock[2 + k % 4]}" for k in range(40)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, own(90, 9)), (None, own(91, 9)), (None, own(91, 9))], "item_id long, text string")
    rows = []
    for k, t in enumerate(texts):
        for cut in range(1, 8):
            words = t.split()
            words[-cut:] = f"{stock[2 + (k + 1) % 4]} {own(k + 100, 9)}".split()[:cut]
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(w if rng.random() > 0.02 * cut else "new" for w in t.split())))
    docs = spark.createDataFrame([*rows, (9000, f"a {own(90, 9)} b"), (9001, own(91, 9))], "doc_id long, text string")
    whole = sorted(map(str, decontaminate.contaminated(docs, items).collect()))
    left = sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 5)
    assert sorted(map(str, decontaminate.contaminated(docs, items).collect())) == whole
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == left and not {9000, 9001} & set(left)
    assert [r.doc_id for r in decontaminate.contaminated(docs, items).where("item_id is null").orderBy("doc_id").collect()] == [9000, 9001]


def test_document_shorter_than_an_item_is_one_window(spark):
    words = [f"w{k}" for k in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:56])), (2, " ".join(words[:30]))], "doc_id long, text string")
    assert [(r.doc_id, r.n_words) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 56)]


def test_simhash_finds_windows_at_the_threshold():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        item = rng.integers(1, 1 << 62, 50).astype(np.uint64)
        index = decontaminate.ItemIndex([(1, np.arange(0))])
        a, b = item.copy(), item.copy()
        b[:5] = rng.integers(1, 1 << 62, 5).astype(np.uint64)  # 45 of 55: similarity 0.82
        prints = [decontaminate._packed(decontaminate._signs(x, np.full(50, 16)).sum(axis=0, keepdims=True)) for x in (a, b)]
        missed += int(decontaminate._distance(prints[0], prints[1])[0] > decontaminate.RADIUS)
    assert index.shingles.size == 0 and missed <= 3


def test_multi_index_is_complete_within_the_radius():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    index = decontaminate.ItemIndex([(1, words)])
    (size, group), = index.sizes.items()
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, decontaminate.RADIUS, replace=False)) for _ in range(2000)], dtype=np.uint64)
    window, _ = index.within_radius(group["prints"][0] ^ flips, size)
    assert len(window) == 2000


def test_multi_index_equals_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    items = rng.integers(1, 1 << 62, (300, 10)).astype(np.uint64)
    index = decontaminate.ItemIndex(list(enumerate(items)))
    (size, group), = index.sizes.items()
    prints = np.concatenate([group["prints"][:100] ^ np.uint64(0b1011), rng.integers(0, 1 << 63, 400).astype(np.uint64)])
    for at_once in (1 << 20, 1000, 1):
        monkeypatch.setattr(decontaminate, "_LOOKED_UP", at_once)
        got = set(zip(*(x.tolist() for x in index.within_radius(prints, size)), strict=True))
        assert got == {(w, i) for w, i in zip(*np.nonzero(np.array([decontaminate._distance(np.full(300, p), group["prints"]) for p in prints]) <= decontaminate.RADIUS), strict=True)}


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.classify(table(spark, d, "documents"), table(spark, d, "labels")).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95 and len(got) > 50


def test_quality_edges(spark, edges):
    labels = spark.createDataFrame([(6, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(edges, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in quality.classify(edges, empty(labels)).collect()} == {0.5}
    assert quality.classify(empty(edges), labels).count() == 0
    assert quality.keep_quality(edges, labels, 0.0).columns == edges.columns


def test_toxicity_of_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    scored = toxicity.classify(docs, labels, excluded=quality.held_out).where(quality.held_out(F.col("doc_id")))
    got = scored.join(docs, "doc_id").join(labels, "doc_id").toPandas()
    listed = got.text.str.contains(r"\b(?:idiot|moron|stupid|clown|loser|trash|scum|worthless|disgusting|pathetic)\b", case=False)
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() >= 0.9
    assert got[(got.toxic == 1) & ~listed].predicted.mean() >= 0.8  # without a word that is plainly toxic


def test_kinds_are_clusters_of_the_toxic_rows():
    rows = [np.array(x) for x in [[1, 2, 9], [1, 2, 8], [1, 2]] * 4 + [[3, 4, 9], [3, 4]] * 4 + [[5, 6]] * 5 + [[7, 8], [7, 9], [7]] * 9 + [[8]]]
    toxic = np.array([1] * 25 + [0] * 28)
    kinds = toxicity.learned_kinds(rows, toxic)
    assert set(kinds[toxic == 0]) == {-1} and all(len(set(kinds[k])) == 1 for k in (slice(0, 12), slice(12, 20), slice(20, 25))) and len(set(kinds[:25])) == 3


def test_scoring_by_known_features_changes_nothing(docs):
    texts = [r.text or "" for r in docs.limit(50).collect()]
    raw, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, first = toxicity.word_ids(raw, at)
    rng = np.random.default_rng(1)
    keys = np.unique(rng.choice(ids, 500))
    known = np.zeros(1 << toxicity.BITS, bool)
    known[keys] = True
    model = toxicity.ChainModel(("a",), (keys,), (rng.normal(size=len(keys)),), (np.zeros(1),))
    assert np.allclose(model.probabilities(ids, first), model.probabilities(*toxicity.word_ids(raw, at, known)))


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(3)
    chance, target = rng.integers(0, 9, 60) / 9, rng.integers(0, 2, 60)
    f1 = lambda th: 2 * target[chance >= th].sum() / ((chance >= th).sum() + target.sum())
    assert f1(toxicity.best_threshold(chance, target)) == max(f1(th) for th in chance)


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(6, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.classify(edges, labels).count() == len(EDGES)
    assert {(r.score, r.predicted) for r in toxicity.classify(edges, empty(labels)).collect()} == {(0.5, 0)}
    assert toxicity.classify(empty(edges), labels).count() == 0
    clash = toxicity.score_toxicity(edges.withColumn("p_toxic", F.lit("x")), toxicity.train_chain(toxicity.labelled_sample(edges, labels, "toxic")))
    assert clash.columns.count("p_toxic") == 1 and {len({r.score for r in clash.collect() if r.text == "a b c d e f g h"})} == {1}


def test_labelled_sample_bounds_rows_not_ids(spark):
    docs = spark.range(1000).select((F.col("id") % 2).alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, "quality").collect()
    assert sorted((r._id, r._label) for r in got) == [(0, 1), (1, 0)]


def test_chain_uses_out_of_fold_probabilities():
    rows = [np.array([k % 2, 2 + k % 3]) for k in range(60)]
    targets = np.array([[k % 2, k % 2] for k in range(60)], float)
    models, unseen = toxicity.fit_chain(rows, targets)
    assert len(unseen) == 60 and len(models[0][1]) == 1 and len(models[1][1]) == 2 and models[1][1][1] > 0


def earliest_deadline_first(parts, slots):
    """The source that runs at each slot, one slot at a time."""
    total, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for t in range(slots):
        ready = [(-((done[x] + 1) * total // -w), -w, x) for x, w in parts.items() if done[x] * total // w <= t]
        x = min(ready)[2]
        done[x] += 1
        out.append(x)
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2, "": 2}, {"a": 0.6664, "b": 0.3331, "c": 0.0005}, {"a": 0.4993, "b": 0.4993, "c": 0.0014}, {"a": 7, "b": 7, "c": 7, "d": 1, "e": 1}])
def test_schedule_equals_earliest_deadline_first_and_deviates_by_less_than_a_block(spark, weights):
    parts = mixing.whole_weights(weights)
    total = sum(parts.values())
    plan = mixing.schedule(mixing.target_weights(spark.createDataFrame([(s, 9) for s in weights], "source string, n long"), weights)).collect()
    assert all(r.cycle_slots == total and r.weight == parts[r.source] == len(r.places) for r in plan)
    got = [x for _, x in sorted((p, r.source) for r in plan for p in r.places)]
    assert got == earliest_deadline_first(parts, total)
    seen = collections.Counter()
    for t, x in enumerate(got):
        seen[x] += 1
        assert all(abs(seen[s] * total - (t + 1) * w) < total for s, w in parts.items())
    share = {s: w / sum(weights.values()) for s, w in weights.items()}
    assert all(abs(w / total - share[s]) < 1e-6 for s, w in parts.items())


def test_mixing_keeps_windows_and_deviation_over_many_cycles(spark):
    sizes = {"a": 700, "b": 200, "c": 90, None: 30}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    parts = {"a": 5, "b": 3, "c": 2, "": 2}  # a source that isn't named has the least weight
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 5.0, "b": 3.0, "c": 2.0}, block=4).select("source", "mix.*").toPandas()
    at = got.cycle * 12 + got.slot
    assert len(got) == len(rows) and got.order.is_unique and ((got.release <= at) & (at < got.deadline)).all()
    whole = min(n // 4 * 12 // parts[s or ""] for s, n in sizes.items())
    seen = collections.Counter()
    for t, s in sorted({(t, s or "") for t, s in zip(at, got.source, strict=True)}):
        if t >= whole:
            break
        seen[s] += 1
        assert all(abs(seen[x] - (t + 1) * w / 12) < 1 for x, w in parts.items())


def test_mixing_of_many_sources(spark):
    counts = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 5 * 100 + 1).alias("n"))
    plan = mixing.schedule(mixing.target_weights(counts)).select("weight", "cycle_slots", F.explode("places").alias("slot"))
    total, slots, different = plan.agg(F.max("cycle_slots"), F.count("*"), F.count_distinct("slot")).first()
    assert total == slots == different


def test_hot_and_null_ids_are_ranked_by_their_content(spark):
    rows = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 250).alias("text"), F.lit("s").alias("source"))
    got = mixing.mix_sources(rows).select("text", "mix.rank").toPandas()
    again = mixing.mix_sources(rows.repartition(7)).select("text", "mix.rank").toPandas()
    assert sorted(got["rank"]) == list(range(500)) and sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))


def test_mixing_edges(spark, edges):
    clash = edges.withColumn("mix", F.lit(1)).withColumn("quota", F.lit(2))
    got = mixing.mix_sources(clash)
    assert got.columns == [*clash.columns, "_mix"] and got.count() == len(EDGES) and mixing.mix_sources(empty(edges)).count() == 0
    assert mixing.in_mix_order(clash).columns == clash.columns


def test_materialised_tokens_round_trip(spark, docs):
    out = materialise.materialise(docs, length=64, shard_rows=16).toPandas()
    assert sorted(out.slot) == list(range(len(out))) and (out.shard == out.slot // 16).all() and (out.byte_offset == out.slot % 16 * 129).all()
    tok = materialise.Tokenizer(materialise.read_vocabulary(materialise.DEFAULT_VOCABULARY))
    o = out.sort_values("sequence")
    ids = np.concatenate([np.frombuffer(x, tok.dtype)[:n] for x, n in zip(o.tokens, o.n_tokens, strict=True)])
    ends = np.flatnonzero(ids == tok.end)
    texts = [tok._bpe.decode(ids[a:b].tolist()) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)]
    assert sorted(texts) == sorted(r.text for r in docs.collect())
    again = materialise.materialise(docs, length=64, shard_rows=16).toPandas()
    assert dict(zip(out.slot, out.tokens, strict=True)) == dict(zip(again.slot, again.tokens, strict=True))


def test_shards_have_a_fixed_stride_and_resume(spark, docs, tmp_path):
    placed = materialise.materialise(docs, length=32, shard_rows=8).persist()
    path = str(tmp_path / "s")
    materialise.write_shards(placed, path, shard_rows=8)
    by_slot = {r.slot: r for r in placed.collect()}
    for first in (0, 5, 8, 1003, len(by_slot)):
        got = [x.tobytes() for x in materialise.read_sequences(spark, path, first, shard_rows=8, length=32)]
        assert got == [bytes(by_slot[k].tokens) for k in range(first, len(by_slot))]
    files = {int(m[1]) * 10**6 + int(m[2]): f for f in (tmp_path / "s").iterdir() if (m := re.search(r"part-(\d+).*-c(\d+)", f.name)) and f.suffix == ".txt"}
    shards = [files[k].read_bytes() for k in sorted(files)]
    assert all(shards[r.shard][r.byte_offset : r.byte_offset + 64] == r.tokens for r in by_slot.values())
    placed.unpersist()


def test_sequences_do_not_depend_on_how_files_are_split(spark, docs, tmp_path):
    path = str(tmp_path / "d")
    docs.repartition(3).write.option("parquet.block.size", 64 << 10).parquet(path)
    out = []
    for size in ("128m", "60k", "200k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        out.append(materialise.materialise(spark.read.parquet(path), length=32, shard_rows=8).orderBy("slot").toPandas())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out[0].equals(out[1]) and out[0].equals(out[2])


def test_windows_of_the_order_stay_together(spark, docs):
    out = materialise.materialise(docs, length=32, shard_rows=8, window=64).toPandas()
    assert sorted(out.slot) == list(range(len(out))) and (out.slot // 64 == out.sequence // 64).all() and (out.slot != out.sequence).any()


def test_tokenizer_cache_changes_nothing():
    tok = materialise.Tokenizer(materialise.read_vocabulary(materialise.DEFAULT_VOCABULARY), cache=3)
    for text in ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b c", "it's 5 o'clock\u00a0now  ", "x\u2003 y", "don't stop don't stop", "\n\n a b"]:
        assert tok.encode(text) == tok._ids(text)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(materialise.Feistel(n, 3)(np.arange(n))) == list(range(n))


def test_materialise_edges(spark, edges):
    assert materialise.materialise(empty(edges)).count() == 0
    out = materialise.materialise(edges, length=16).toPandas()
    assert out.n_tokens.sum() > len(EDGES) and sorted(out.slot) == list(range(len(out)))


def base_row(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = sorted((i, label) for p, label in licences.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licence_base_columns_equal_brute_force(spark, docs):
    hard = ["CC BY-NC 4.0 cc by cc_by", "ALL RIGHTS RESERVED. all rights\nreserved", "GNU General Public License v3", "Éall rights reservedÉ", "", None]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(hard)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: base_row(t) for i, t in rows}


def test_licence_suppression():
    base, kept = licences.detections(licences.normalised("Licensed under the Apache License, Version 2.0. All rights reserved."))
    assert [x.rule.label for x in kept] == ["apache-2.0", "reserved"] and len(base) == 1
    base, kept = licences.detections(licences.normalised("SPDX-License-Identifier: GPL-3.0-or-later"))
    assert [x.rule.label for x in kept] == ["gpl-3.0"] and len(licences.rules()) > 200


def test_licence_suppression_equals_pairwise_comparison():
    text = "Copyright (c) 2001 2002 X. Licensed under the MIT license. See the MIT License; GPL v3, GNU General Public License version 3. All rights reserved. " * 30
    _, kept = licences.detections(licences.normalised(text))
    assert {"copyright-notice", "mit", "gpl-3.0", "reserved"} <= {x.rule.label for x in kept} and kept
    for a in kept:  # nothing stands inside one of a rule that is as good or better
        assert not any(b is not a and b.start <= a.start and a.end <= b.end and b.rule.priority >= a.rule.priority for b in kept)


@pytest.mark.parametrize("part", range(8))
def test_gate_is_no_stricter_than_the_rules(part):
    """Texts generated from each rule's own pattern pass its gate."""
    rng = random.Random(part)
    for rule in licences.rules()[part::8]:
        for _ in range(4):
            text = generated_from(re._parser.parse(rule.pattern.pattern.decode()), rng)
            assert rule.pattern.search(text.encode()) and rule in licences.gated(f"aa {text} bb".encode()), (rule.label, text)


def generated_from(pattern, rng):
    """A random text that the pattern matches."""
    out = ""
    for kind, value in pattern:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "NOT_LITERAL" or kind == "IN" and str(value[0][0]) == "NEGATE":
            out += "x"
        elif kind == "IN":
            out += rng.choice(["7" if str(k) == "CATEGORY" and "DIGIT" in str(v) else "x" if str(k) == "CATEGORY" else chr(v) for k, v in value])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            out += "".join(generated_from(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        elif kind == "SUBPATTERN":
            out += generated_from(value[3], rng)
        elif kind == "BRANCH":
            out += generated_from(rng.choice(value[1]), rng)
        else:
            assert kind == "ASSERT_NOT", kind
    return out


def test_labels_and_scores_equal_ungated_brute_force(spark, docs):
    rng = random.Random(8)
    pieces = [generated_from(re._parser.parse(rng.choice(licences.rules()).pattern.pattern.decode()), rng) for _ in range(300)]
    texts = [r.text for r in docs.limit(60).collect()] + [" ".join(rng.sample(pieces, 3) + ["plain words"]) for _ in range(150)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words = licences.normalised(text)
        place = lambda at, w=words: w[:at].count(b" ")
        found = [(place(m.start()), place(m.end()) + 1, r) for r in licences.rules() for m in r.pattern.finditer(words)]
        inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
        kept = [x for x in found if not any(inside(x, y) and (y[2].priority > x[2].priority or y[2].priority == x[2].priority and (y[:2] != x[:2] or (y[2].label, found.index(y)) < (x[2].label, found.index(x)))) for y in found if y is not x)]
        base = {x[2].label for x in found if x[2].base}
        assert got[k].labels == ",".join(sorted(base | {x[2].label for x in kept})), text
        assert got[k].score == max([x[2].confidence for x in kept] + [0.5] * bool(base), default=0.0)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("GNU Library General Public License, version 2", "lgpl-2.0"), ("https://opensource.org/license/mit", "mit"), ("GPLv3", "gpl-3.0"), ("GPL-2.0+", "gpl-2.0"), ("License: MIT", "mit"), ("Apache 2.0 licence", "apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or without\n modification, are permitted", "bsd"),
    ],
)
def test_common_forms_of_licences(text, label):
    assert label in {x.rule.label for x in licences.detections(licences.normalised(text))[1]}


def test_licence_edges(spark, edges):
    got = licences.scan_licences(edges)
    assert got.count() == len(EDGES) and licences.scan_licences(empty(edges)).count() == 0
    assert got.columns.count("labels") == 1 and "source" in got.columns
