"""Toxicity by a chain of classifiers.

Categories are predicted one after the other; the last is the labelled one. Each
category has a linear model over hashed features (presence of each distinct word and
of the first bytes of words) and the probabilities of the categories before it.
A later model is trained with out-of-fold probabilities: those of a fold come from
models that have not seen it, so the chain meets at prediction what it met in
training.

There is one label, so the earlier categories are learned too: the features that
tell the labelled toxic texts from the others best are found in the training rows, and
the toxic rows are clustered by which of these they hold; each cluster is a
category ("kind_0", ...). The threshold above which a text is predicted toxic is the
one with the best F1 on out-of-fold probabilities of the last category. Models are
fitted by FTRL updates on a bounded sample of the labelled rows (MAX_TRAINING_ROWS,
the smallest by hash) in one task; scoring is one scan of the documents.

Defined results: null and empty texts score by the biases alone; rows that
repeat score alike; very long texts are read whole; ties of the threshold count as toxic; an empty table gives an
empty table; without labels all probabilities are 0.5 and nothing is predicted toxic;
a column of docs that has a result's name is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._frames import with_arrow_columns
from ._text import ALNUM, LOWER, chunks, mix, spans, word_hashes
from .quality import labelled_sample

MAX_TRAINING_ROWS = 6_000
FOLDS = 3
BITS = 20
#: Bytes of the beginnings of words that are features.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Learned categories before the labelled one, and features that they are learned from.
KINDS, TELLING = 3, 256
LABELLED = "toxic"


@dataclass(frozen=True)
class ChainModel:
    """Each category's sparse weights, bias and weights of earlier categories, and
    the probability of the last from which a text is predicted."""

    names: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    dense: tuple[np.ndarray, ...]
    threshold: float = 1.0

    def probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row per text, one column per category, in the chain's order."""
        out = np.zeros((len(at) - 1, len(self.names)))
        for c in range(len(self.names)):
            keys, w = self.words[c], self.weights[c]
            part = np.zeros(len(ids))
            if len(keys) and len(ids):
                place = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
                part = np.where(keys[place] == ids, w[place], 0.0)
            total = np.concatenate([[0.0], np.cumsum(part)])
            logit = total[at[1:]] - total[at[:-1]] + self.dense[c][0] + out[:, :c] @ self.dense[c][1:]
            out[:, c] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        return out


def word_ids(raw: np.ndarray, at: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, rising, with n + 1 offsets; only the
    known ones (a flag for each feature), if these are given."""
    raw = LOWER[raw]
    starts, ends, first = spans(raw, at, ALNUM)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    every, of = [word_hashes(raw, starts, ends)], [owner]
    for k in PREFIXES:
        long = ends - starts > k
        every.append(mix(word_hashes(raw, starts[long], starts[long] + k) + np.uint64(k)))
        of.append(owner[long])
    ids, of = (np.concatenate(every) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)
    if known is not None:
        keep = np.flatnonzero(known[ids])
        ids, of = ids[keep], of[keep]
    pairs = np.unique(of << BITS | ids)
    return pairs & ((1 << BITS) - 1), np.searchsorted(pairs, np.arange(len(at)) << BITS)


def _fit(rows: list[np.ndarray], extra: np.ndarray, target: np.ndarray, alpha: float = 0.3, l1: float = 3.0, l2: float = 0.1, epochs: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Weights over the words and over [1, earlier probabilities], by FTRL."""
    size = 1 << BITS
    z, n = np.zeros(size + 1 + extra.shape[1]), np.zeros(size + 1 + extra.shape[1])
    tail = np.arange(size, len(z))
    penalty = np.full(len(z), l1)
    penalty[size:] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= penalty[i], 0.0, (np.sign(z[i]) * penalty[i] - z[i]) / ((1 + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for ids, more, y in zip(rows, extra, target, strict=True):
            i = np.concatenate([ids, tail])
            x = np.ones(len(i))
            x[len(ids) + 1 :] = more
            w = weights(i)
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    return w[:size], w[size:]


def _chance(w: np.ndarray, dense: np.ndarray, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
    logits = np.array([w[ids].sum() for ids in rows]) + dense[0] + extra @ dense[1:]
    return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def learned_kinds(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The cluster (0 to KINDS - 1) of each toxic row, -1 for the others and for
    those without a telling feature."""
    kinds = np.full(len(rows), -1)
    ours = np.flatnonzero(toxic == 1)
    if not len(ours):
        return kinds
    count = lambda some: np.bincount(np.concatenate([np.zeros(0, np.int64), *(rows[k] for k in some)]), minlength=1 << BITS)
    yes, no = count(ours), count(np.flatnonzero(toxic == 0))
    share, base = yes / len(ours), (no + 1) / (len(rows) - len(ours) + 1)
    gain = np.where((yes >= 3) & (share > base), share * np.log(np.maximum(share, 1e-12) / base), 0.0)
    telling = np.sort(np.argsort(-gain, kind="stable")[:TELLING])
    telling = telling[gain[telling] > 0]
    x = np.array([np.isin(telling, rows[k]) for k in ours], float).reshape(len(ours), -1)
    some = np.flatnonzero(x.any(axis=1)) if x.shape[1] else np.zeros(0, np.int64)
    if not len(some):
        return kinds
    x = x[some] / np.linalg.norm(x[some], axis=1, keepdims=True)
    centres = x[[int(np.argmax(x.sum(axis=1)))]]
    while len(centres) < KINDS:  # the row that is least like any centre
        centres = np.vstack([centres, x[int(np.argmin((x @ centres.T).max(axis=1)))]])
    for _ in range(10):
        mine = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[mine == k].sum(axis=0) if (mine == k).any() else centres[k] for k in range(KINDS)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    kinds[ours[some]] = np.argmax(x @ centres.T, axis=1)
    return kinds


def best_threshold(chance: np.ndarray, target: np.ndarray) -> float:
    """The probability from which predicting the label has the best F1."""
    order = np.argsort(-chance, kind="stable")
    caught = np.cumsum(target[order])
    f1 = 2 * caught / (np.arange(1, len(order) + 1) + target.sum())
    last = np.append(chance[order][1:] != chance[order][:-1], True)  # ties go together
    return float(chance[order][int(np.argmax(np.where(last, f1, -1)))])


def fit_chain(rows: list[np.ndarray], targets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A model for each column of targets; later ones see out-of-fold
    probabilities. Also those of the last."""
    models, extra, fold = [], np.zeros((len(rows), 0)), np.arange(len(rows)) % FOLDS
    for c in range(targets.shape[1]):
        models.append(_fit(rows, extra, targets[:, c]))
        unseen = np.zeros(len(rows))
        for f in range(FOLDS):
            train, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(held):
                w, dense = _fit([rows[k] for k in train], extra[train], targets[train, c])
                unseen[held] = _chance(w, dense, [rows[k] for k in held], extra[held])
        extra = np.column_stack([extra, unseen])
    return models, extra[:, -1]


def train_chain(sample: DataFrame) -> ChainModel:
    """Fits the chain in one task on a sample that its maker has bounded."""
    names = (*(f"kind_{k}" for k in range(KINDS)), LABELLED)

    def featurise(batches):
        for batch in batches:
            for part, raw, at in chunks(batch, "_text"):
                ids, first = word_ids(raw, at)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("_order"), part.column("_id").cast(pa.int64()), part.column("_label"), lists], names=["_order", "_id", "_label", "ids"])

    def fit(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_order", "_id", "_label")), (x.values.to_numpy().astype(np.int64) for x in b.column("ids")), strict=True)]
        rows.sort(key=lambda r: (*r[:3], len(r[3]), r[3].tobytes()))
        if not rows:
            return
        toxic = np.array([r[2] for r in rows])
        kinds = learned_kinds([r[3] for r in rows], toxic)
        targets = np.array([*(kinds == k for k in range(KINDS)), toxic == 1], np.float64).T
        models, unseen = fit_chain([r[3] for r in rows], targets)
        threshold = best_threshold(unseen, targets[:, -1]) if toxic.any() else 1.0
        for c, (w, dense) in enumerate(models):
            keys = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "keys": [keys.astype(np.int64).tobytes()], "w": [w[keys].tobytes()], "dense": [dense.tobytes()], "threshold": [threshold]})

    feats = sample.mapInArrow(featurise, "_order long, _id long, _label int, ids array<int>")
    got = {r["c"]: r for r in feats.repartition(1).mapInArrow(fit, "c int, keys binary, w binary, dense binary, threshold double").collect()}
    read = lambda c, name, kind: np.frombuffer(got[c][name], kind) if c in got else np.zeros(0, kind)
    dense = tuple(read(c, "dense", np.float64) if c in got else np.zeros(c + 1) for c in range(len(names)))
    return ChainModel(names, tuple(read(c, "keys", np.int64) for c in range(len(names))), tuple(read(c, "w", np.float64) for c in range(len(names))), dense, got[0]["threshold"] if got else 1.0)


def score_toxicity(docs: DataFrame, model: ChainModel, text: str = "text") -> DataFrame:
    """All columns of docs, p_<category> for each, score (that of the labelled
    category) and predicted (1 from the model's threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(f"p_{n}", T.DoubleType()) for n in model.names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make(batch):
        known = np.zeros(1 << BITS, bool)
        for keys in shared.value.words:
            known[keys] = True
        for part, raw, at in chunks(batch, text):
            p = shared.value.probabilities(*word_ids(raw, at, known))
            yield part, [pa.array(c) for c in p.T.copy()] + [pa.array(p[:, -1].copy()), pa.array((p[:, -1] >= shared.value.threshold).astype(np.int32))]

    return with_arrow_columns(docs, fields, make)


def classify(docs: DataFrame, labels: DataFrame, excluded=None) -> DataFrame:
    """doc_id and the chain's results for every row of docs. ``excluded``: a
    predicate on the ids whose labels aren't learned from."""
    model = train_chain(labelled_sample(docs, labels, "toxic", MAX_TRAINING_ROWS, excluded))
    return score_toxicity(docs.select("doc_id", "text"), model).drop("text")
