"""Generated texts that copy no long run, against plain Python."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from loomtext.operators import lm as L
from loomtext.plans import lm as plans


def model(sentences, n):
    counts = collections.defaultdict(collections.Counter)
    for t in sentences:
        padded = [L.BOS] * (n - 1) + t + [L.EOS]
        for k in range(n - 1, len(padded)):
            counts[tuple(padded[k - n + 1 : k])][padded[k]] += 1
    return counts


def drawn(counts, n, text, words, seed):
    out, now = [], (L.BOS,) * (n - 1)
    for pos in range(words):
        u = int(hashlib.md5(f"{seed}|{text}|{pos}".encode()).hexdigest()[:8], 16) / (1 << 32)
        total, upto = sum(counts[now].values()), 0
        for w, c in sorted(counts[now].items()):
            upto += c
            if u < upto / total:
                break
        if w == L.EOS:
            break
        out.append(w)
        now = (*now, w)[1:]
    return out


def copied(t, sentences, share, most):
    n = min(int(share * len(t) + 0.5) + 1, most + 1, len(t))
    runs = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    return any(tuple(s[k : k + n]) in runs for s in sentences for k in range(len(s) - n + 1))


def test_texts_equal_plain_python_and_none_is_a_copy(spark):
    rng = random.Random(51)
    sentences = [rng.choices("abcdef", [6, 5, 4, 3, 2, 1], k=rng.randint(1, 9)) for _ in range(40)]
    train = spark.createDataFrame(list(enumerate(sentences)), "sid long, t array<string>")
    for n, share, most, tries in [(2, 0.6, 15, 3), (3, 0.2, 1, 2)]:
        got = {r.text: (r.tries, r.t) for r in L.generate_original(train, n, 25, 7, share, most, tries, seed=5).collect()}
        counts, expected = model(sentences, n), {}
        for text in range(25):
            for k in range(tries):
                t = drawn(counts, n, text, 7, 5 + 7919 * k)
                if t and not copied(t, sentences, share, most):
                    expected[text] = (k + 1, t)
                    break
        assert got == expected
        assert not any(copied(t, sentences, share, most) for _, t in got.values())
    assert any(k > 1 for k, _ in got.values()) or len(got) < 25


def test_no_source_and_no_texts(spark):
    train = spark.createDataFrame([(1, ["a"])], "sid long, t array<string>")
    assert L.generate_original(train.where("false"), 2, 3, 4, tries=2).count() == 0
    assert L.generate_original(train, 2, 3, 4, tries=2).count() == 0  # every text is the source


def test_texts_over_conversations(spark):
    sf = "/root/testdata/sf0.001"
    source = [r.t for r in plans._sentences(spark, sf)[0].collect()]
    rows = plans.lm_generate_original(spark, sf).collect()
    assert 0 < len(rows) <= 20
    found = L.generate_original(plans._sentences(spark, sf)[0], 3, 20, 20, tries=5, seed=7)
    assert not any(copied(r.t, source, 0.7, 15) for r in found.collect())
    lines = plans.lm_generate_characters(spark, sf).collect()
    assert all(3 <= len(r.line) <= 30 for r in lines)
    assert not any(copied(list(r.line), [list(" ".join(t)) for t in source], 0.9, 20) for r in lines)
