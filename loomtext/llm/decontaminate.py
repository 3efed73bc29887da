"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits, A-Z lower-cased; shingles have five
words. A shingle's weight grows with its rarity among the items. For every item size
(number of shingles), windows of that size slide over a document. A window that
shares no shingle with any item has similarity 0, so only windows over at
least one item shingle are fingerprinted (64-bit weighted SimHash). A document
that is shorter than an item is a single window. Fingerprints
are looked up in a multi-index: the 64 bits are cut into 10 blocks, and a
pair within 19 bits agrees in at least one block up to one bit, so the block
tables (with all values one bit away) find every item of that size within the
radius. Candidates are verified by the exact weighted Jaccard similarity of
window and item. At similarity 0.8 the expected distance is 10 bits with a
deviation of 3, so 19 leaves out less than 1 in 1000 of the windows that are just
at the threshold; a copy has distance 0.

Items of fewer than five words match where their words stand in a row; items
without words match nothing. The items are a query set: they are broadcast in
blocks of about ``MAX_ITEMS`` or ``MAX_BYTES``, and each block meets all documents. Rarity is counted over
all items, whatever their blocks. Null and empty texts match nothing; rows that
repeat match alike. Items without an id are one item (of id null) for each text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._text import ALNUM, LOWER, chunks, mix, shingle_hashes, spans, text_buffer, word_hashes

SHINGLE = 5
#: Items and bytes of their texts that are broadcast at once; more are more blocks.
MAX_ITEMS, MAX_BYTES = 20_000, 32 << 20
#: Pairs of windows and items that are looked up at once.
_LOOKED_UP = 1 << 20
#: 10 blocks with one bit of tolerance each find all within 10 * 2 - 1 bits.
BLOCKS, RADIUS = 10, 19

_EDGES = [round(k * 64 / BLOCKS) for k in range(BLOCKS + 1)]
_BITS = np.arange(64, dtype=np.uint64)
_POPULATION = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _signs(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each shingle's weight, as + or - in each of the 64 bits."""
    return np.where((mix(shingles ^ np.uint64(0x51))[:, None] >> _BITS) & np.uint64(1), weights[:, None], -weights[:, None]).astype(np.int64)


def _packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits a to b (exclusive) of each fingerprint."""
    return ((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(_POPULATION[((a ^ b) >> np.uint64(s)) & np.uint64(0xFFFF)].astype(np.int64) for s in (0, 16, 32, 48))


def _repeated(seen: Counter) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (rising) that several items have, and how many items."""
    rows = sorted((x, n) for x, n in seen.items() if n > 1)
    return np.array([x for x, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


@dataclass
class ItemIndex:
    """Shingles, weights, fingerprints and block tables of a block of items."""

    words: list[tuple[object, np.ndarray]]
    #: Of all items: how many have SHINGLE words, the shingles (rising) of two or
    #: more of them, and of how many. Without it, the block's items are all.
    everywhere: tuple[int, np.ndarray, np.ndarray] | None = None
    shingles: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: dict[int, dict] = field(default_factory=dict)
    size_of: dict[int, set[int]] = field(default_factory=dict)
    short: dict[int, dict[int, list]] = field(default_factory=dict)
    most: int = 1

    def __post_init__(self) -> None:
        full = []
        for item, words in self.words:
            if 0 < len(words) < SHINGLE:
                key, _ = shingle_hashes(words, np.array([0, len(words)]), len(words))
                self.short.setdefault(len(words), {}).setdefault(int(key[0]), []).append(item)
            elif len(words):
                full.append((item, shingle_hashes(words, np.array([0, len(words)]), SHINGLE)[0]))
        self.words = []
        if not full:
            return
        seen = Counter(int(x) for _, s in full for x in set(s.tolist()))
        self.shingles = np.array(sorted(seen), np.uint64)
        total, self.common, counts = self.everywhere or (len(full), *_repeated(seen))
        self.everywhere = None
        scale = math.log(1 + total)
        self.weights = np.array([round(8 * (1 + math.log((1 + total) / n) / scale)) for n in counts.tolist()], np.int64)
        self.most = round(8 * (1 + math.log(1 + total) / scale))
        for item, s in full:
            group = self.sizes.setdefault(len(s), {"items": [], "bags": [], "prints": []})
            w = self.weight(s)
            group["items"].append(item)
            group["bags"].append(self.bag(s, w))
            group["prints"].append(_packed(_signs(s, w).sum(axis=0, keepdims=True))[0])
            for x in s.tolist():
                self.size_of.setdefault(x, set()).add(len(s))
        for group in self.sizes.values():
            group["prints"] = prints = np.array(group["prints"], np.uint64)
            # a table of each block: items by the block's value, and where each value begins
            group["tables"] = []
            for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True):
                value = _block(prints, a, b)
                order = np.argsort(value, kind="stable")
                group["tables"].append((order, np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))))

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        """Weights; a shingle of no item weighs as much as one of a single item."""
        if not len(self.common):
            return np.full(len(shingles), self.most, np.int64)
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return np.where(self.common[at] == shingles, self.weights[at], self.most)

    @staticmethod
    def bag(shingles: np.ndarray, weights: np.ndarray) -> dict[int, int]:
        """Total weight of each distinct shingle."""
        out: dict[int, int] = {}
        for x, w in zip(shingles.tolist(), weights.tolist(), strict=True):
            out[x] = out.get(x, 0) + w
        return out

    def within_radius(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one size at a distance of at most RADIUS."""
        group, out = self.sizes[size], []
        n = len(group["prints"])
        step = max(1, _LOOKED_UP // n)
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            found = np.zeros(len(some) * n, bool)  # a pair that several blocks give counts once
            for (order, begin), a, b in zip(group["tables"], _EDGES[:-1], _EDGES[1:], strict=True):
                value = _block(some, a, b)
                for near in (0, *(1 << k for k in range(b - a))):
                    first, many = begin[value ^ near], begin[(value ^ near) + 1] - begin[value ^ near]
                    if total := int(many.sum()):
                        place = np.repeat(first - np.cumsum(many) + many, many) + np.arange(total)
                        found[np.repeat(np.arange(len(some)) * n, many) + order[place]] = True
            window, item = np.divmod(np.flatnonzero(found), n)
            near = _distance(some[window], group["prints"][item]) <= RADIUS
            out.append((at + window[near], item[near]))
        window, item = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return window, item

    def matches(self, words: np.ndarray, shingles: np.ndarray, hits: np.ndarray, threshold: float) -> Iterator[tuple[object, float, int, int]]:
        """(item, similarity, first word, number of words) of matching windows."""
        for size in sorted({s for x in shingles[hits].tolist() for s in self.size_of[x]}):
            at = np.array([h for h in hits.tolist() if size in self.size_of[int(shingles[h])]])
            width = min(size, len(shingles))
            cover = np.zeros(len(shingles) - width + 2, np.int64)
            np.add.at(cover, np.maximum(at - width + 1, 0), 1)
            np.add.at(cover, np.minimum(at, len(shingles) - width) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for block in range(0, len(part), 4096):
                    yield from self._windows(shingles, part[block : block + 4096], size, width, threshold)

    def _windows(self, shingles: np.ndarray, starts: np.ndarray, size: int, width: int, threshold: float) -> Iterator[tuple[object, float, int, int]]:
        if not len(starts):
            return
        region = shingles[starts[0] : starts[-1] + width]
        weights = self.weight(region)
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_signs(region, weights), axis=0)])
        window, item = self.within_radius(_packed(sums[width:] - sums[:-width]), size)
        group, bags = self.sizes[size], {}
        for w, i in zip(window.tolist(), item.tolist(), strict=True):
            mine = bags.get(w)
            if mine is None:
                mine = bags[w] = self.bag(region[w : w + width], weights[w : w + width])
            other = group["bags"][i]
            common = sum(min(x, other[k]) for k, x in mine.items() if k in other)
            similarity = common / (sum(mine.values()) + sum(other.values()) - common)
            if similarity >= threshold:
                yield group["items"][i], similarity, int(starts[0]) + w, width + SHINGLE - 1


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = LOWER[raw]
    starts, ends, first = spans(raw, at, ALNUM)
    return word_hashes(raw, starts, ends), first


def shingle_counts(known: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """ItemIndex.everywhere, counted by Spark over all items."""

    def run(batches):
        for batch in batches:
            for _, raw, at in chunks(batch, "text"):
                words, first = _words(raw, at)
                full = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True) if b - a >= SHINGLE]
                sets = [np.unique(shingle_hashes(w, np.array([0, len(w)]), SHINGLE)[0]) for w in full]
                tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                column = pa.array([None, *tokens.view(np.int64).tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([column, pa.array([len(full), *counts.tolist()], pa.int64())], names=["token", "n"])

    counts = known.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where("token is null or n > 1").toArrow()
    total = sum(n for t, n in zip(rows.column("token").to_pylist(), rows.column("n").to_pylist(), strict=True) if t is None)
    rows = rows.filter(rows.column("token").is_valid())
    tokens, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    return total, tokens[order], n[order]


def item_indexes(items: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of all items, MAX_ITEMS at a time. Their items are (0, item_id),
    or (1, number of the text) without an id."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    number, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-number // MAX_ITEMS), -(-size // MAX_BYTES))
    everywhere = shingle_counts(known) if blocks > 1 else None
    block = F.pmod(F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id")), F.lit(blocks))
    for k in range(blocks):
        part = known.where(block == k).orderBy("item_id", "text").toArrow()
        text = part.column("text").combine_chunks()
        words, first = _words(*text_buffer(text if isinstance(text, pa.Array) else pa.array([], pa.string())))
        numbers: dict[str, int] = {}
        keys = [(0, i) if i is not None else (1, numbers.setdefault(t, len(numbers))) for i, t in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
        yield ItemIndex([(i, words[a:b]) for i, a, b in zip(keys, first[:-1], first[1:], strict=True)], everywhere)


def _found(index: ItemIndex, gate: np.ndarray, raw: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, object, float, int, int, int]]:
    """(row, item, best similarity, its first word, words, windows) of a chunk."""
    words, first = _words(raw, at)
    shingles, own = shingle_hashes(words, first, SHINGLE)
    best: dict[tuple[int, object], list] = {}

    def note(row: int, item: object, similarity: float, word: int, size: int) -> None:
        old = best.get((row, item))
        if old is None:
            best[row, item] = [similarity, word, size, 1]
        else:
            old[3] += 1
            if similarity > old[0]:
                old[:3] = similarity, word, size

    if len(index.shingles) and len(shingles):
        maybe = np.flatnonzero(gate[(shingles & np.uint64(len(gate) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(index.shingles, shingles[maybe]), len(index.shingles) - 1)
        hits = maybe[index.shingles[place] == shingles[maybe]]
        rows, begin = np.unique(np.searchsorted(own, hits, "right") - 1, return_index=True)
        for row, of in zip(rows.tolist(), np.split(hits, begin[1:]) if len(hits) else (), strict=True):
            if first[row + 1] - first[row] >= SHINGLE:
                mine = slice(own[row], own[row + 1])
                for m in index.matches(words[first[row] : first[row + 1]], shingles[mine], of - own[row], threshold):
                    note(row, *m)
    for size, items in index.short.items():
        keys, at_key = shingle_hashes(words, first, size)
        for place in np.flatnonzero(np.isin(keys, np.array(list(items), np.uint64))):
            row = int(np.searchsorted(at_key, place, "right") - 1)
            if first[row + 1] - first[row] >= size:
                for item in items[int(keys[place])]:
                    note(row, item, 1.0, int(place - at_key[row]), size)
    for (row, item), (similarity, word, size, n) in sorted(best.items()):
        yield row, item, similarity, word, size, n


def _gate(index: ItemIndex) -> np.ndarray:
    gate = np.zeros(1 << 20, bool)
    gate[(index.shingles & np.uint64(len(gate) - 1)).astype(np.int64)] = True
    return gate


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), first_word, n_words and
    n_windows (that reach the threshold) of every document and item that match."""
    out = None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    for index in item_indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            gate = _gate(shared.value)
            for batch in batches:
                for part, raw, at in chunks(batch, "text"):
                    ids = part.column("doc_id")
                    rows = [(ids[r].as_py(), None if item[0] else item[1], *rest) for r, item, *rest in _found(shared.value, gate, raw, at, threshold)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        one = source.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long, n_windows long")
        out = one if out is None else out.unionAll(one)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without a window that matches an item, in one scan."""
    schema: T.StructType = docs.schema
    for index in item_indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            gate = _gate(shared.value)
            for batch in batches:
                for part, raw, at in chunks(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, *_ in _found(shared.value, gate, raw, at, threshold)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
