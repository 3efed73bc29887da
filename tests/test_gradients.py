"""Mini-batch gradients against plain numpy in the same order, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import gradients as G, vectors as V
from loomtext.plans import learning


def rings(rng, n):
    """Two classes that no line divides."""
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 2, 1.0, 3.0) + rng.normal(0, 0.2, n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), np.arange(n) % 2


def frame(spark, x, y):
    return spark.createDataFrame([(int(k), v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "key long, vec array<double>, label int").repartition(5)


@pytest.mark.parametrize("loss", ["hinge", "log"])
@pytest.mark.parametrize("kernel", [False, True])
def test_steps_equal_numpy(spark, loss, kernel):
    x, y = rings(np.random.default_rng(1), 200)
    rows = frame(spark, x, y)
    features = G.Fourier.draw(2, 16, 0.5, seed=3) if kernel else None
    got = G.fit(rows, 2, loss, epochs=2, batches=3, rate=0.7, l2=0.01, seed=9, features=features).weights
    batch = {r.key: r.b for r in rows.select("key", G.dealt(F.col("key"), 3, 9).alias("b")).collect()}
    z = np.sqrt(2 / 16) * np.cos(x @ features.weights + features.shifts) if kernel else x
    w, bias = np.zeros(z.shape[1]), 0.0
    for step in range(6):
        own = [k for k in range(200) if batch[k] == step % 3]
        dw, db = np.zeros_like(w), 0.0
        for k in own:
            sign = 2 * y[k] - 1
            s = z[k] @ w + bias
            g = (-sign if sign * s < 1 else 0.0) if loss == "hinge" else -sign / (1 + np.exp(sign * s))
            dw, db = dw + g * z[k], db + g
        rate = 0.7 / np.sqrt(1 + step)
        w, bias = w - rate * (dw / len(own) + 0.01 * w), bias - rate * db / len(own)
    assert got == pytest.approx(np.append(w, bias), abs=1e-9)


def test_the_kernel_divides_what_no_line_does(spark):
    rng = np.random.default_rng(2)
    x, y = rings(rng, 600)
    rows, more = frame(spark, x, y), frame(spark, *rings(rng, 300))
    accuracy = lambda model: more.transform(lambda d: G.predicted(d, model)).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    assert accuracy(G.fit(rows, 2, epochs=3)) < 0.75
    assert accuracy(G.fit(rows, 2, epochs=3, rate=2.0, features=G.Fourier.draw(2, 64, 1.0, seed=1))) > 0.95


def test_random_features_tend_to_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (30, 5))
    z = G.Fourier.draw(5, 20_000, 0.3, seed=1)(x)
    assert z @ z.T == pytest.approx(np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2)), abs=0.04)


def test_hashed_features_and_no_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "k int, t array<string>")
    got = {r.k: r.vec for r in V.hashed_features(docs, "k", F.col("t"), 8).collect()}
    assert sorted(x for x in got[1] if x) == pytest.approx(sorted(np.log1p([1, 2]) / np.hypot(*np.log1p([1, 2])))) and got[2] == got[3] == [0.0] * 8
    empty = G.fit(docs.select(F.col("k").alias("key"), F.array(F.lit(1.0)).alias("vec"), F.lit(1).alias("label")).where("false"), 1, epochs=1, batches=2)
    assert (empty.weights == 0).all()


def test_quality_of_documents(spark):
    got = {r.classifier: r for r in learning.gradient_classifiers(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"linear hinge", "linear log", "kernel hinge"} and all(r.accuracy > 0.8 for r in got.values()), got
