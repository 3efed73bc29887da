"""Text representations, splits and evaluation; models come from pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..sources.stored import written
from .tokens import each


def stratified_split(df: DataFrame, label: str, key: Column, share: float = 0.8) -> DataFrame:
    """Adds ``split``: within each label the share of rows with the least key is
    train. Ranks come from buckets of the key, so no label is one sort."""
    rows = df.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 2))
    sizes = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    over = W.partitionBy(label).orderBy("_b")
    sizes = sizes.select(label, "_b", F.coalesce(F.sum("_n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(label)).alias("_all"))
    ranked = rows.withColumn("_i", F.row_number().over(W.partitionBy(label, "_b").orderBy("_k"))).join(F.broadcast(sizes), [label, "_b"])
    place = F.col("_before") + F.col("_i")
    return ranked.select(*df.columns, F.when(place <= F.floor(F.col("_all") * share), "train").otherwise("test").alias("split"))


def term_counts(docs: DataFrame, key: str, units: Column) -> DataFrame:
    """(key, term, tf) of the units of each document. Where ``docs`` are dealt by key, nothing is shuffled."""
    return each(docs, units, "term", key).groupBy(key, "term").agg(F.count("*").alias("tf"))


def letter_runs(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many runs of three to five letters each word has with a blank at both ends, and these runs."""
    blank, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    text = pc.binary_join_element_wise(blank, words.cast(pa.large_string()), blank, nothing)
    letters = np.frombuffer(text.buffers()[2], np.uint8)
    begins = np.append(np.flatnonzero((letters & 0xC0) != 0x80), len(letters))  # of code points
    length = pc.utf8_length(text).to_numpy()
    left = np.repeat(np.cumsum(length), length) - np.arange(length.sum())  # code points to the word's end
    many = np.clip(left - 2, 0, 3)
    first = np.repeat(np.arange(len(many)), many)
    n = 3 + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    size = begins[first + n] - begins[first]
    bounds = np.append(0, np.cumsum(size))
    runs = letters[np.repeat(begins[first] - bounds[:-1], size) + np.arange(bounds[-1])]
    return np.maximum(3 * length - 9, length - 2), pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(runs)).cast(pa.string())


#: What gives the number of terms of each unit, and these terms.
Terms = Callable[[pa.Array], tuple[np.ndarray, pa.Array]]
#: Documents whose counts are added at once, and bytes of the units that are spelled at once.
_BLOCK, _BYTES = 16, 128 << 10
#: What stands between the units of a document.
_BETWEEN = "\u0000"


def _parts(units: pa.Array) -> Iterator[slice]:
    """Runs of units of about _BYTES."""
    upto = np.cumsum(pc.binary_length(units).to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff(upto // _BYTES)) + 1).tolist(), len(units)]
    return (slice(a, b) for a, b in pairwise(cuts) if a < b)


def _distinct(bags: DataFrame, key: str) -> DataFrame:
    """Distinct units of each batch in ``term``: how often they stand there (tf), and the keys of the first and last document with them."""
    kind = bags.schema[key].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("lo", kind), T.StructField("hi", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bag, keys = pc.split_pattern(batch.column("units"), _BETWEEN), batch.column(key)
            found = bag.flatten().dictionary_encode()
            unit, doc = found.indices.to_numpy(), np.repeat(np.arange(len(bag)), pc.list_value_length(bag).to_numpy())
            first, last = np.empty((2, len(found.dictionary)), np.int64)
            first[unit[::-1]], last[unit] = doc[::-1], doc
            yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.bincount(unit, minlength=len(last))), keys.take(pa.array(first)), keys.take(pa.array(last))], names=schema.names)

    return bags.mapInArrow(run, schema)


def _spelled(units: DataFrame, terms: Terms) -> DataFrame:
    """A row for each term of each unit in ``term``, with the unit's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _parts(whole.column("term")):
                batch = whole[part]
                sizes, found = terms(batch.column("term"))
                of = batch.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield of.set_column(of.schema.get_field_index("term"), "term", found)

    return units.mapInArrow(run, units.schema)


def _kept_ids(units: pa.Array, kept: pa.Array, terms: Terms | None) -> tuple[np.ndarray, np.ndarray]:
    """How many terms of each unit are kept, and their places in ``kept``, unit by unit."""
    many, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32 if _BLOCK * len(kept) < 1 << 31 else np.int64)]
    for part in _parts(units):
        sizes, found = (np.ones(part.stop - part.start, np.int64), units[part]) if terms is None else terms(units[part])
        at = pc.index_in(found, value_set=kept)
        upto, ends = np.append(0, np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))), np.cumsum(sizes)
        many.append(upto[ends] - upto[ends - sizes])
        ids.append(at.drop_null().to_numpy())
    return np.concatenate(many), np.concatenate(ids)


def _kept_counts(units: pa.Array, kept: pa.Array, terms: Terms | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (their places in ``units``), kept terms and counts of a block of documents, in this order.
    Terms are sought once for equal units."""
    bags = pc.split_pattern(units, _BETWEEN)
    found = bags.flatten().dictionary_encode()
    unit, bounds = found.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(bags).to_numpy()))
    sizes, ids = _kept_ids(found.dictionary, kept, terms)
    begins, width = np.cumsum(sizes) - sizes, max(len(kept), 1)
    for first in range(0, len(bags), _BLOCK):
        ends = bounds[first : first + _BLOCK + 1]
        here = unit[ends[0] : ends[-1]]
        size = sizes[here]
        cell = ids[np.repeat(begins[here] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        cell += np.repeat(np.repeat(np.arange(len(ends) - 1, dtype=cell.dtype) * width, np.diff(ends)), size)
        cells, sums = np.unique(cell, return_counts=True)
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(cells, np.arange(len(ends)) * width)))
        yield first + doc, cells - doc * width, sums


def tf_idf(docs: DataFrame, key: str, units: Column, terms: Terms | None = None, max_features: int = 50_000, decimals: int = 6) -> DataFrame:
    """(key, term, weight): smooth idf ln((1 + N) / (1 + df)) + 1, rows of length one, rounded; of the terms in two
    documents or more the most frequent in the corpus are kept (ties by term).

    ``units`` (not empty, without U+0000) are terms, or consist of those that ``terms`` gives (one at least, as often as a unit has it).
    Where ``docs`` are dealt by key, nothing of a document is shuffled: which terms are kept is found from the distinct units,
    only these terms pass the driver, and rows of documents and terms are made once, as they leave."""
    spark, scale = docs.sparkSession, 10**decimals
    rows = docs.select(key, F.array_join(units, _BETWEEN).alias("units")).groupBy(key).agg(F.collect_list("units").alias("units"))
    bags = written(rows.select(key, F.array_join(F.filter("units", lambda u: u != ""), _BETWEEN).alias("units")).where("units <> ''"))
    n = bags.count()
    of_term = [F.sum("tf").alias("tf"), F.min(F.least("lo", "hi")).alias("lo"), F.max(F.greatest("lo", "hi")).alias("hi")]
    counts = _distinct(bags, key).groupBy("term").agg(*of_term)
    if terms is not None:
        counts = _spelled(counts, terms).groupBy("term").agg(*of_term)
    leading = written(counts.where("lo < hi").orderBy(F.desc("tf"), "term").limit(max_features).select("term"))  # else each part's would pass the driver
    kept = [r["term"] for r in leading.collect()]
    shared = spark.sparkContext.broadcast(kept)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = pa.array(shared.value, pa.string()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, term, _ in _kept_counts(batch.column("units"), known, terms):
                df += np.bincount(term, minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "df"])

    df = np.zeros(len(kept))
    for r in bags.select("units").mapInArrow(documents, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    idf = spark.sparkContext.broadcast(np.log((1 + n) / (1 + df)) + 1)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            for doc, term, tf in _kept_counts(batch.column("units"), known, terms):
                x, at = tf * idf.value[term], doc - doc[:1].sum()
                weight = np.floor(x / np.sqrt(np.bincount(at, x * x))[at] * scale + 0.5) / scale
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(doc)), known.take(pa.array(term)), pa.array(weight)], names=[key, "term", "weight"])

    return bags.mapInArrow(weights, T.StructType([bags.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def hashed_features(docs: DataFrame, key: str, units: Column, buckets: int) -> DataFrame:
    """key and vec: ln(1 + count) of the units in each bucket of their hash, rows of length one;
    a document without units is all zeros."""
    slot = F.pmod(F.xxhash64("u"), F.lit(buckets)).cast("int")
    counts = each(docs, units, "u", key).groupBy(key, slot.alias("slot")).agg(F.log1p(F.count("*").cast("double")).alias("x"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.coalesce(F.element_at("m", k) / F.col("norm"), F.lit(0.0)))
    return docs.select(key).join(held, key, "left").select(key, vec.alias("vec"))


def mean_vectors(tokens: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """(key, vector, tokens, known): the mean of the known tokens' vectors, zeros
    if there is none. tokens: (key, w); vectors: (w, vec)."""
    joined = tokens.join(vectors, "w", "left")
    sums = [F.coalesce(F.avg(F.get("vec", F.lit(i)).cast("double")), F.lit(0.0)) for i in range(width)]
    return joined.groupBy(key).agg(F.array(*sums).alias("vector"), F.count("*").alias("tokens"), F.count("vec").alias("known"))


def standardise(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, both from the
    rows that ``fit_on`` selects (all without it); a constant column is 0."""
    base = df.where(fit_on) if fit_on is not None else df
    stats = base.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    both = df.join(F.broadcast(stats))
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return both.withColumns(scaled).select(*df.columns)


#: Queries that meet a scan of the training rows at once.
QUERY_BLOCK = 8192


def nearest(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, label, distance): the k nearest training rows (id, label, vec) of
    each query (query, qvec), itself left out; ties to the smaller id.

    Queries are a stated set: a block of them is sent to a scan of the training rows,
    where each task keeps its own k best, so no pair beyond those leaves a task."""
    spark, out = train.sparkSession, None
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    schema = f"query long, id long, label {train.schema['label'].dataType.simpleString()}, distance double"
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select(F.col("query").cast("long").alias("query"), "qvec").toPandas()
        sent = spark.sparkContext.broadcast((part["query"].to_numpy(), np.array(part["qvec"].tolist(), np.float64)))

        def best(batches, sent=sent):
            names, wanted = sent.value
            held: dict[int, list] = {}
            for batch in batches:
                ids, labels = batch.column("id").to_numpy(), batch.column("label")
                vecs = np.array(batch.column("vec").to_pylist(), np.float64)
                step = max(1, (1 << 20) // max(vecs.size, 1))  # 8 MB of differences at once, about
                for at in range(0, len(names) if len(ids) else 0, step):
                    d = np.sqrt(((wanted[at : at + step, None, :] - vecs) ** 2).sum(axis=2))
                    for q, row in zip(names[at : at + step].tolist(), d, strict=True):
                        row[ids == q] = np.inf
                        near = np.lexsort((ids, row))[:k] if len(ids) <= 4 * k else np.flatnonzero(row <= np.partition(row, k)[k])
                        mine = held.setdefault(q, []) + [(row[i], int(ids[i]), labels[i].as_py()) for i in near.tolist() if row[i] < np.inf]
                        held[q] = sorted(mine, key=lambda x: x[:2])[:k]
            rows = [(q, i, label, float(d)) for q, mine in held.items() for d, i, label in mine]
            if rows:
                kinds = [pa.int64(), pa.int64(), labels.type, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query", "id", "label", "distance"])

        near = train.select(F.col("id").cast("long").alias("id"), "label", "vec").mapInArrow(best, schema)
        out = near if out is None else out.unionAll(near)
    over = W.partitionBy("query").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """(query, predicted): the most frequent label; ties to the smaller one."""
    return neighbours.groupBy("query", "label").count().groupBy("query").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("predicted"))


def evaluate(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """tn, fp, fn, tp, accuracy and F1 of the positive class."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    sums = df.groupBy(*by).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))
    all_, both = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return sums.withColumn("accuracy", (F.col("tn") + F.col("tp")) / all_).withColumn("f1", F.when(both > 0, 2 * F.col("tp") / both).otherwise(0.0))
