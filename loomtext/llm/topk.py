"""Exact top-k inner products from an impact-ordered index, score at a time.

Component x becomes floor(scale * x). The vectors are dealt into blocks of
bounded size; so are the queries, and every block of vectors meets every block
of queries in a task of its own (the queries are a stated set that meets
all rows; nothing is broadcast).

In a task the block's index has a posting list for each dimension and sign,
cut into segments of equal quantised impact: |value| div STEP. Segments are
processed by descending impact, for all open queries at once; each adds its impact
(the middle of its range) times the query's component to the accumulators of its
vectors. What is left can change a score by at most sum |q_d| * (largest
impact left in d, or half a range; the whole largest impact of a dimension that
no segment has touched yet). A query stops only when its k-th lower bound
leaves so few possible members that rescoring them exactly is cheaper than
going on, or when all segments are done; its possible members are then always
rescored exactly. Ties go to the smaller id: members are all vectors whose upper
bound reaches the k-th lower bound, equal ones included.

Defined results: null vectors and vectors that hold null, NaN or infinite
components, of another length than the most frequent one, or without an id
take no part; equal vectors are ranked by id; rows that repeat an id are candidates each
(all but those of the query's own id), and an id that repeats among the queries asks with its smallest
vector, component by component, however the rows lie; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Vectors and queries of a task, at most about.
VECTORS, QUERIES = 8192, 256
#: Width of a quantised impact.
STEP = 8
#: Possible members that are cheaper to rescore than to refine, per query.
CHEAP = 128


class ImpactIndex:
    """Posting segments of a block of integer vectors, by descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors)
        level = size // STEP
        #: level -> [(dimension, sign, rows)]
        self.segments: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for d in range(self.vectors.shape[1]):
            key = level[:, d] * 2 + (self.vectors[:, d] > 0)
            rows = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[rows])) + 1
            for part in np.split(rows, cuts):
                v = self.vectors[part[0], d]
                self.segments.setdefault(int(abs(v)) // STEP, []).append((d, 1 if v > 0 else -1, part))
        self.largest = size.max(axis=0) if len(size) else np.zeros(self.vectors.shape[1], np.int64)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, vector, score) of each query's k best of this block."""
        out: list[tuple[int, int, int]] = []
        n = len(self.ids)
        open_ = np.arange(len(query_ids))
        scores = np.zeros((n, len(query_ids)))
        weight = np.abs(queries).astype(np.float64)
        for level in sorted(self.segments, reverse=True):
            for d, sign, rows in self.segments[level]:
                q = queries[open_, d] * (sign * (level * STEP + (STEP - 1) / 2))
                scores[rows] += q
            done = level == min(self.segments)
            rest = max((STEP - 1) / 2, level * STEP - 1)
            left = weight[open_] @ np.where(self.largest < level * STEP, self.largest, rest)
            if not done and level * STEP > 3 * STEP:
                continue  # no proof can hold so early that pays for a look
            own = self.ids[:, None] == query_ids[open_][None, :]
            low = np.where(own, -np.inf, scores)
            kth = np.partition(low, n - k, axis=0)[n - k] - left if n > k else np.full(len(open_), -np.inf)
            members = (scores + left >= kth) & ~own
            ready = np.full(len(open_), True) if done else members.sum(axis=0) <= CHEAP
            for j in np.flatnonzero(ready):
                who = np.flatnonzero(members[:, j])
                exact = self.vectors[who] @ queries[open_[j]]
                best = np.lexsort((self.ids[who], -exact))[:k]
                out += [(int(query_ids[open_[j]]), int(self.ids[who[b]]), int(exact[b])) for b in best]
            open_, scores = open_[~ready], np.ascontiguousarray(scores[:, ~ready])
            if not len(open_):
                break
        return out


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    values = table.column("v").combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return table.column("id").to_numpy(), values.flatten().to_numpy().reshape(-1, width).astype(np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k largest integer inner products of
    each row that ``is_query`` (a predicate on the id) selects, with all other rows."""
    parts = vectors.select(F.col(id_column).cast("long").alias("id"), F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.col(vector_column).alias("raw"))
    sound = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = parts.where(F.col("id").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0) & sound).select("id", "v")
    widths = parts.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = (widths["width"], widths["count"]) if widths else (1, 0)
    parts = parts.where(F.size("v") == width)
    queries = parts.where(is_query(F.col("id")))
    blocks = max(1, -(-n // VECTORS))
    query_blocks = max(1, -(-queries.count() // QUERIES))

    own_block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    own_query = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int")
    left = parts.withColumn("b", own_block).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("q", own_query).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if block.num_rows and asked.num_rows:
            index = ImpactIndex(*_matrix(block, width))
            ids, values = _matrix(asked, width)
            order = np.lexsort((*values.T[::-1], ids))  # of an id's vectors the smallest comes first
            ids, first = np.unique(ids[order], return_index=True)
            values = values[order]
            for at in range(0, len(ids), QUERIES):
                rows += index.top(ids[at : at + QUERIES], values[first][at : at + QUERIES], k)
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
) WHERE rank <= 5
"""
