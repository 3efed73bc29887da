"""Vector compression by product codes, the codebooks fitted by the filtering form of Lloyd.

Components become integers floor(scale * x), and a vector is cut into ``PARTS`` equal parts.

1. One pass cuts every partition into blocks of rows and builds a kd-tree over each part of a
   block: nodes have their bounding boxes and cached sums and counts. The trees are
   written once; every round starts from these files.
2. In a round the nodes of a tree are visited level by level with the entries that may
   still be nearest to a point of the box. The entry nearest to the box's middle eliminates every
   other one that isn't nearer at any corner; equal distances go to the lower index. Where one
   entry is left the whole subtree is assigned by its cached sum and count; points of
   leaves that keep several entries are compared one by one. Tasks add up sums and counts for
   each part and entry, and only those totals (at most PARTS * ENTRIES rows) come back.
3. After the last round the points are assigned once more in the same way.

All arithmetic is exact: in doubles where they hold every number that can occur, else in
64-bit integers.

Defined results: vectors that are null or hold null or non-finite components take no
part, nor do those of another length than the commonest (of equally common ones the
shortest); a length that PARTS doesn't divide is filled up with zeros at the end; rows without an
id come last in the order of ids, rows of one id by their components; rows that repeat are
coded alike; with fewer rows than ENTRIES there are as many entries; integers are kept
within the limit of ``_limit`` (2^26 for parts of 16), so that errors fit into a long; an empty table gives an
empty one; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._frames import small
from ._store import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows that share trees, and points of a leaf.
BLOCK_ROWS = 4096
LEAF = 24
#: Nodes whose boxes are compared with the entries at once.
_AT_ONCE = 256

_TREE = [("points", pa.binary()), ("order", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary()), ("spans", pa.binary()), ("child", pa.binary())]
_BLOCKS = "ids array<bigint>, labels array<string>, trees array<struct<points: binary, order: binary, low: binary, high: binary, sums: binary, spans: binary, child: binary>>"


def _limit(width: int) -> int:
    """The largest integer of a component: errors of PARTS parts stay below 2^62."""
    return 1 << ((60 - width.bit_length()) // 2 - 1)


def _exact(width: int, *arrays: np.ndarray) -> type:
    """The type in which squared distances of these integers are exact."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return np.float64 if most < 1 << ((52 - width.bit_length()) // 2 - 1) else np.int64


class Tree:
    """A kd-tree over the points of one part, as arrays; points stand in the order of its leaves."""

    def __init__(self, points, order, low, high, sums, spans, child) -> None:
        self.points, self.order, self.low, self.high, self.sums, self.spans, self.child = points, order, low, high, sums, spans, child

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Splits at the median of the widest side until few points are left or all are equal."""
        order = np.arange(len(points))
        spans, child, low, high = [(0, len(points))], [-1], [], []
        k = 0
        while k < len(spans):
            a, b = spans[k]
            own = points[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            sides = high[-1] - low[-1]
            if b - a > leaf and sides.any():
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(sides.argmax())], middle)]
                child[k] = len(spans)
                spans += [(a, a + middle), (a + middle, b)]
                child += [-1, -1]
            k += 1
        own = points[order]
        sums = np.zeros((len(own) + 1, points.shape[1]), np.int64)
        np.cumsum(own, axis=0, out=sums[1:])
        ends = np.array(spans, np.int32)
        return cls(own, order.astype(np.int32), np.array(low), np.array(high), sums[ends[:, 1]] - sums[ends[:, 0]], ends, np.array(child, np.int32))

    def packed(self) -> dict[str, bytes]:
        kinds = {"points": np.int32, "low": np.int32, "high": np.int32}
        return {n: np.ascontiguousarray(getattr(self, n), kinds.get(n)).tobytes() for n, _ in _TREE}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], width: int) -> Tree:
        flat = {n: np.frombuffer(row[n], np.int64 if n == "sums" else np.int32) for n, _ in _TREE}
        shaped = {n: x.reshape(-1, 2 if n == "spans" else width) if n not in ("order", "child") else x for n, x in flat.items()}
        return cls(**shaped)

    def filtered(self, entries: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(node, entry) of subtrees that one entry takes whole, and places and nearest
        entries of the points that were compared one by one."""
        kind = _exact(entries.shape[1], self.low[:1], self.high[:1], entries)
        z, low, high = entries.astype(kind), self.low.astype(kind), self.high.astype(kind)
        square = (z * z).sum(axis=1)
        far = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
        whole: list[tuple[int, int]] = []
        places: list[np.ndarray] = []
        nearest: list[np.ndarray] = []
        number = np.arange(len(z))
        while len(nodes):
            down, masks = [], []
            for at in range(0, len(nodes), _AT_ONCE):
                part, mask = nodes[at : at + _AT_ONCE], open_[at : at + _AT_ONCE]
                score = square - (low[part] + high[part]) @ z.T  # distance to the middle, less what is equal for all
                best = np.where(mask, score, far).argmin(axis=1)
                reach = np.einsum("mkw,mw->mk", np.abs(z[None] - z[best][:, None]), high[part] - low[part])
                nearer = score - score[np.arange(len(part)), best][:, None] - reach  # the least lead of best over an entry
                mask = mask & ((nearer < 0) | ((nearer == 0) & (number < best[:, None])))
                mask[np.arange(len(part)), best] = True
                one = mask.sum(axis=1) == 1
                whole += zip(part[one].tolist(), best[one].tolist(), strict=True)
                leaf = self.child[part] < 0
                for node, m in zip(part[~one & leaf].tolist(), mask[~one & leaf], strict=True):
                    a, b = self.spans[node].tolist()
                    left = np.flatnonzero(m)
                    own = self.points[a:b].astype(kind)
                    places.append(np.arange(a, b))
                    nearest.append(left[(square[left] - 2 * (own @ z[left].T)).argmin(axis=1)])
                inner = ~one & ~leaf
                first = self.child[part[inner]]
                down.append(np.stack([first, first + 1], axis=1).reshape(-1).astype(np.int64))
                masks.append(np.repeat(mask[inner], 2, axis=0))
            nodes, open_ = np.concatenate(down), np.concatenate(masks)
        none = np.zeros(0, np.int64)
        return whole, np.concatenate([none, *places]), np.concatenate([none, *nearest])

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the points of each entry."""
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        whole, places, nearest = self.filtered(entries)
        for node, entry in whole:
            sums[entry] += self.sums[node]
            counts[entry] += self.spans[node][1] - self.spans[node][0]
        np.add.at(sums, nearest, self.points[places].astype(np.int64))
        np.add.at(counts, nearest, 1)
        return sums, counts

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, in the rows' own order, and the squared distance."""
        out = np.empty(len(self.points), np.int64)
        whole, places, nearest = self.filtered(entries)
        for node, entry in whole:
            out[self.spans[node][0] : self.spans[node][1]] = entry
        out[places] = nearest
        error = ((self.points.astype(np.int64) - entries[out]) ** 2).sum(axis=1)
        back = np.empty_like(out)
        back[self.order] = np.arange(len(out))
        return out[back], error[back]


def _cut(values: np.ndarray, scale: int) -> np.ndarray:
    """Parts [row, part, position] of the vectors' integers."""
    width = -(-values.shape[1] // PARTS)
    most = _limit(width)
    whole = np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, width * PARTS - values.shape[1]))).reshape(-1, PARTS, width)


def _trees(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """A row for each block: its ids and labels in their order, and a tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            parts = _cut(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
            trees = [Tree.build(parts[:, p]).packed() for p in range(PARTS)]
            columns = [pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([t.column("label").to_pylist()], pa.list_(pa.string())), pa.array([trees], pa.list_(pa.struct(_TREE)))]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                    yield block()
                    held = []
        if sum(b.num_rows for b in held):
            yield block()

    return rows.mapInArrow(run, _BLOCKS)


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all trees."""
    width = books[0].shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    columns = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in shared.value]
        for batch in batches:
            for trees in batch.column("trees"):
                for p, row in enumerate(trees.as_py()):
                    s, n = Tree.unpacked(row, width).totals(shared.value[p])
                    sums[p] += s
                    counts[p] += n
        for p, (s, n) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), *(pa.array(s[used, k]) for k in range(width))], names=["part", "entry", "n", *columns])

    schema = ", ".join(["part int", "entry int", "n long", *(f"{c} long" for c in columns)])
    totals = blocks.select("trees").mapInArrow(run, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *columns)))
    out = [b.copy() for b in books]
    for r in totals.collect():  # at most one row for each entry of the codebooks
        out[r["part"]][r["entry"]] = [r[c] // r["n"] for c in columns]
    return out


def _coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of each row."""
    width = books[0].shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(k) for k in range(3)), strict=True):
                code, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, row in enumerate(trees.as_py()):
                    entry, distance = Tree.unpacked(row, width).assigned(shared.value[p])
                    code[:, p] = entry
                    error += distance
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "trees").mapInArrow(run, "vec_id long, label string, code string, error long")


def fit(rows: DataFrame, blocks: DataFrame, width: int, scale: int = SCALE, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part; they start as the parts of the rows with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").collect()
    parts = _cut(np.array([r["v"] for r in first], np.float64).reshape(-1, width), scale)
    books = [parts[:, p].copy() for p in range(PARTS)]
    for _ in range(rounds):
        books = _round(blocks, books)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = SCALE, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every sound vector."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.col(label_column).cast("string").alias("label"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    found = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = found["width"] if found else PARTS
    rows = rows.where(F.size("v") == width)
    blocks = written(_trees(rows, width, scale))
    books = fit(rows, blocks, width, scale, rounds) if found else [np.zeros((0, 1), np.int64)] * PARTS
    coded = written(_coded(blocks, books))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(small(sums), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Lloyd by comparing each part with every entry; the inner products are of integers
    in doubles, far below 2^53."""
    steps = [
        """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "p AS MATERIALIZED (SELECT vec_id, label, k AS part, list_slice(v, k * (len(v) // 4) + 1, (k + 1) * (len(v) // 4)) AS p FROM v, range(4) r(k))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS z FROM p QUALIFY entry < 256)",
    ]
    nearest = "arg_min(b.entry, (list_inner_product(b.z, b.z) - 2 * list_inner_product(p.p, b.z), b.entry))"
    for k in range(ROUNDS):
        steps += [
            f"a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.p) AS p, {nearest} AS entry FROM p JOIN b{k} b USING (part) GROUP BY 1, 2)",
            f"m{k} AS (SELECT part, entry, i, floor(sum(x) / count(*)) AS x FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{k}) GROUP BY 1, 2, 3)",
            f"n{k} AS (SELECT part, entry, list(x ORDER BY i) AS z FROM m{k} GROUP BY 1, 2)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.z, b.z) AS z FROM b{k} b LEFT JOIN n{k} n USING (part, entry))",
        ]
    steps += [
        f"f AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.label) AS label, any_value(p.p) AS p, {nearest} AS entry FROM p JOIN b{ROUNDS} b USING (part) GROUP BY 1, 2)",
        f"e AS (SELECT f.vec_id, any_value(f.label) AS label, string_agg(printf('%02x', f.entry), '' ORDER BY f.part) AS code, CAST(sum(list_inner_product(f.p, f.p) - 2 * list_inner_product(f.p, b.z) + list_inner_product(b.z, b.z)) AS BIGINT) AS error FROM f JOIN b{ROUNDS} b USING (part, entry) GROUP BY 1)",
        f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(z, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS})",
        "l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM e GROUP BY 1)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT e.vec_id, e.code, e.error, l.label_error, h.h AS codebooks_sha256 FROM e JOIN l ON e.label IS NOT DISTINCT FROM l.label, h"


ORACLE_SQL = _oracle()
