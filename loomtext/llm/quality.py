"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot
products.

A text becomes tokens: maximal runs of letters and digits, and maximal runs of
other visible bytes, A-Z lower-cased. A token that repeats one of the two
before it counts as one common "repeated" token, so that the model can learn
repetition of words it has never seen. Unigrams and bigrams are hashed into
``2 ** bits`` weights. A text's score is a sigmoid of the bias and the mean
weight of its n-grams, so length alone does not move it.

Defined results: null and empty texts score by the bias alone; repeated rows
get equal scores; very long texts are read whole; an empty table gives an empty table; without labels every
score is 0.5, with labels of one class the score is near that class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._frames import free_name, with_arrow_columns
from ._text import ALNUM, LOWER, NOT_SPACE, chunks, mix, runs, shingle_hashes, word_hashes

#: Most labelled rows that a model is fitted on (the smallest by hash).
MAX_TRAINING_ROWS = 10_000

_KIND = np.where(ALNUM, 1, np.where(NOT_SPACE, 2, 0)).astype(np.uint8)
_REPEATED = np.uint64(0x5EED)
_SCALE = 24.0


@dataclass(frozen=True)
class FtrlModel:
    """Weights of the hashed n-grams; the last one is the bias."""

    bits: int
    weights: np.ndarray

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bias and mean weight of each text's n-grams: a sparse dot product."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        count = np.diff(at)
        return self.weights[-1] + _SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(count, 1)


def ngram_ids(raw: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigram and bigram ids of each text and their n + 1 offsets."""
    raw = LOWER[raw]
    starts, ends, first = runs(raw, at, _KIND)
    words = word_hashes(raw, starts, ends)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    tokens = words.copy()
    for back in (1, 2):
        same = (words[back:] == words[:-back]) & (text[back:] == text[:-back])
        tokens[back:][same] = _REPEATED
    pairs, pair_at = shingle_hashes(tokens, first, 2)
    shift = np.uint64(64 - bits)
    every = np.concatenate([mix(tokens ^ np.uint64(1)) >> shift, pairs >> shift]).astype(np.int64)
    owner = np.concatenate([text, np.repeat(np.arange(len(at) - 1), np.diff(pair_at))])
    order = np.argsort(owner, kind="stable")
    return every[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at) - 1))])


def ftrl(examples: list[tuple[np.ndarray, int]], bits: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> np.ndarray:
    """FTRL-proximal over the examples in their order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for ids, label in examples * epochs:
        i, times = np.unique(ids, return_counts=True)
        x = np.append(times * (_SCALE / max(len(ids), 1)), 1.0)
        i = np.append(i, 1 << bits)
        w = weights(i)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = (p - label) * x
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
        n[i] += g * g
    return weights(np.arange(len(z)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_TRAINING_ROWS, excluded=None) -> DataFrame:
    """At most ``most`` labelled texts, those with the smallest hash of doc_id; of
    the texts of an id that repeats, one (that of the smallest hash).

    The ids and labels of the sample are broadcast (``most`` rows bound them),
    so the documents are only scanned. ``excluded``: a predicate on doc_id.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    if excluded is not None:
        known = known.where(~excluded(F.col("_id")))
    chosen = known.distinct().withColumn("_order", F.xxhash64(F.col("_id").cast("string"))).orderBy("_order", "_id", "_label").limit(most)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return found.groupBy("_order", "_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))


def train_quality(sample: DataFrame, bits: int = 18) -> FtrlModel:
    """Fits the model in one task: the sample is bounded by its maker."""

    def featurise(batches):
        for batch in batches:
            for part, raw, at in chunks(batch, "_text"):
                ids, first = ngram_ids(raw, at, bits)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("_order"), part.column("_id").cast(pa.int64()), part.column("_label"), lists], names=["_order", "_id", "_label", "ids"])

    def fit(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_order", "_id", "_label")), (x.values.to_numpy() for x in b.column("ids")), strict=True)]
        rows.sort(key=lambda r: (*r[:3], len(r[3]), r[3].tobytes()))
        w = ftrl([(r[3], r[2]) for r in rows], bits)
        yield pa.RecordBatch.from_pydict({"weights": [w.astype(np.float32).tobytes()]})

    feats = sample.mapInArrow(featurise, "_order long, _id long, _label int, ids array<int>")
    got = feats.repartition(1).mapInArrow(fit, "weights binary").first()
    weights = np.frombuffer(got[0], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)
    return FtrlModel(bits, weights)


def score_quality(docs: DataFrame, model: FtrlModel, output: str = "score", text: str = "text") -> DataFrame:
    """All columns of docs and the probability of label 1 of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        for part, raw, at in chunks(batch, text):
            logits = shared.value.logits(*ngram_ids(raw, at, shared.value.bits))
            yield part, [pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))]

    return with_arrow_columns(docs, [T.StructField(output, T.DoubleType())], make)


def held_out(doc_id):
    """The rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = train_quality(labelled_sample(docs, labels, "quality", excluded=held_out))
    scored = score_quality(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least ``threshold``, with docs' columns."""
    model = train_quality(labelled_sample(docs, labels, "quality", excluded=held_out))
    name = free_name(docs, "score")
    return score_quality(docs, model, name).where(F.col(name) >= threshold).drop(name)
