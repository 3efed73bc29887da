"""Full-text search over stored postings, and the scan that they replace.

``postings`` has a row for each token: (term, doc_id, field, pos). ``stored`` writes
them once for each version of a table, a row for each term, field and document with
its places and the field's length. Documents are dealt over files of bounded size, each sorted
by terms, so places are gathered inside a document and only texts are shuffled; a term that stands
everywhere is spread over files, and a query reads the row groups
of its terms. A query is a small tree of Term, Phrase, And, Or and Not; all of its
leaves are answered in one aggregation by document. Phrases never cross fields.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import STOP_WORDS
from ..sources.stored import bytes_of, kept, written
from .tokens import each


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Index:
    """postings (see ``grouped``), terms (with docs and places) and sizes (avgdl and
    docs of each field)."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame


#: Bytes of a row group of stored postings, so that a term reads little else.
ROW_GROUP = 1 << 20
#: Bytes of the documents' files that one file of postings is made of, so that its sort stays in memory.
PART = 8 << 20
#: Terms that are broadcast at most.
_FEW = 100_000


def analyse(c: Column) -> Column:
    """Lower-case runs of letters and digits without stop words; places are kept."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    placed = F.transform(tokens, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    return F.filter(placed, lambda x: ~x["term"].isin(*STOP_WORDS))


def postings(docs: DataFrame, fields: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """The postings of the fields, from their texts."""
    out = None
    for f in fields:
        part = docs.select(F.col(key).alias("doc_id"), analyse(F.col(f)).alias("x")).select("doc_id", F.explode("x").alias("x")).select("x.term", "doc_id", F.lit(f).alias("field"), "x.pos")
        out = part if out is None else out.unionAll(part)
    return out


def grouped(places: DataFrame) -> DataFrame:
    """A row for each term, field and document: pos (its places, rising) and dl
    (the places of all terms in the document's field)."""
    rows = places.groupBy("term", "field", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
    lengths = rows.groupBy("field", "doc_id").agg(F.sum(F.size("pos")).alias("dl"))
    return rows.join(lengths, ["field", "doc_id"]).select("term", "field", "doc_id", "pos", "dl")


def by_document(docs: DataFrame, fields: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """``grouped(postings(docs, fields))`` by arrays of one document, without a shuffle of places; and ``head``,
    whether the row is the first of its term and document. Rows without a key have no postings."""
    docs = docs.where(F.col(key).isNotNull())
    none = F.array().cast("array<struct<term:string,at:bigint>>")
    # the place of a word of the k-th field is its own and k * 2^32
    placed = lambda k, f: F.coalesce(F.transform(analyse(F.col(f)), lambda x: F.struct(x["term"].alias("term"), (x["pos"] + F.lit(k << 32)).alias("at"))), none).alias(f"x{k}")
    rows = docs.select(F.col(key).alias("doc_id"), *(placed(k, f) for k, f in enumerate(fields)))
    names = [f"x{k}" for k in range(len(fields))]
    again = docs.groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():  # rows of one key are one document
        merged = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in names))
        rows = rows.join(again, "doc_id", "left_anti").unionAll(merged)
    rows = rows.select("doc_id", F.sort_array(F.concat(*names)).alias("x"), F.array(*(F.size(x) for x in names)).alias("dl"))
    field = lambda y: F.shiftright(y["at"], 32).cast("int")
    before = lambda i: F.get("x", i - 1)
    begins = F.array_compact(F.transform("x", lambda y, i: F.when((before(i)["term"] == y["term"]) & (field(before(i)) == field(y)), None).otherwise(i)))
    rows = rows.select("doc_id", "x", "dl", F.when(F.size("x") > 0, begins).alias("s"))
    runs = F.arrays_zip(F.col("s").alias("a"), F.concat(F.slice("s", 2, 1 << 30), F.array(F.size("x"))).alias("b"))
    first = lambda r: F.get("x", r["a"])
    pos = lambda r: F.transform(F.slice("x", r["a"] + 1, r["b"] - r["a"]), lambda y: y["at"].bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    run = lambda r: F.struct(first(r)["term"].alias("term"), field(first(r)).alias("k"), pos(r).alias("pos"), (~before(r["a"])["term"].eqNullSafe(first(r)["term"])).alias("head"))
    out = each(rows, F.transform(runs, run), "r", "doc_id", "dl")
    return out.select("r.term", F.get(F.array(*map(F.lit, fields)), F.col("r.k")).alias("field"), "doc_id", "r.pos", F.get("dl", F.col("r.k")).cast("long").alias("dl"), "r.head")


def stored(docs: DataFrame, path: str, fields: tuple[str, ...], name: str) -> Index:
    """The index of docs' fields, made once for each version of the table at
    ``path`` that docs comes from; ``name`` tells apart indexes of one table."""
    spark = docs.sparkSession

    def make(folder: str) -> None:
        size = bytes_of(spark, path)
        parts = max(-(-size // PART), min(-(-size // ROW_GROUP), spark.sparkContext.defaultParallelism), 1)
        dealt = docs.select("doc_id", *fields).repartition(parts, "doc_id")
        by_document(dealt, fields).sortWithinPartitions("term", "field", "doc_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/postings")
        made = spark.read.parquet(f"{folder}/postings")
        made.groupBy("term").agg(F.count_if("head").alias("docs"), F.sum(F.size("pos")).alias("places")).write.parquet(f"{folder}/terms")
        lengths = made.select("field", "doc_id", "dl").distinct()
        lengths.groupBy("field").agg(F.avg("dl").alias("avgdl"), F.count("*").alias("docs")).coalesce(1).write.parquet(f"{folder}/sizes")

    folder = kept(spark, path, name, make)
    return Index(*(spark.read.parquet(f"{folder}/{x}") for x in ("postings", "terms", "sizes")))


def in_memory(places: DataFrame) -> Index:
    """An index of postings that aren't stored (small tables and tests)."""
    rows = grouped(places)
    lengths = rows.select("field", "doc_id", "dl").distinct()
    return Index(rows, rows.groupBy("term").agg(F.count_distinct("doc_id").alias("docs"), F.sum(F.size("pos")).alias("places")), lengths.groupBy("field").agg(F.avg("dl").alias("avgdl"), F.count("*").alias("docs")))


def _leaves(q) -> list:
    if isinstance(q, (Term, Phrase)):
        return [q]
    parts = [q.part] if isinstance(q, Not) else q.parts
    return list(dict.fromkeys(x for p in parts for x in _leaves(p)))


def _phrase(hits: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """doc_id of documents with the words at places in a row: the places where the phrase would begin by
    each of its words have one in common."""
    places = {w: F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("pos")))).alias(f"w{k}") for k, w in enumerate(dict.fromkeys(words))}
    held = hits.where(F.col("term").isin(*words)).groupBy("doc_id", "field").agg(*places.values())
    order = list(places)
    begins = lambda k, w: F.transform(f"w{order.index(w)}", lambda p: p - k)
    common = reduce(F.array_intersect, (begins(k, w) for k, w in enumerate(words)))  # a word may stand twice in a phrase
    return held.where(F.size(common) > 0).select("doc_id").distinct()


def search(index: Index, query) -> DataFrame:
    """doc_id of the matching documents; a Not stands inside an And only."""
    leaves = _leaves(query)
    words = sorted({w for x in leaves for w in (x.words if isinstance(x, Phrase) else (x.word,))})
    hits = index.postings.where(F.col("term").isin(*words))
    terms = [x for x in leaves if isinstance(x, Term)]
    rows = None
    if terms:
        leaf = F.create_map(*(y for x in terms for y in (F.lit(x.word), F.lit(leaves.index(x)))))
        rows = hits.where(F.col("term").isin(*(x.word for x in terms))).select("doc_id", leaf[F.col("term")].alias("leaf"))
    for x in leaves:
        if isinstance(x, Phrase):
            part = _phrase(hits, x.words).select("doc_id", F.lit(leaves.index(x)).alias("leaf"))
            rows = part if rows is None else rows.unionAll(part)
    if len(leaves) == 1:
        return rows.select("doc_id").distinct()
    flags = rows.groupBy("doc_id").agg(*(F.bool_or(F.col("leaf") == k).alias(f"leaf{k}") for k in range(len(leaves))))

    def holds(q) -> Column:
        if isinstance(q, Not):
            return ~holds(q.part)
        if isinstance(q, (And, Or)):
            out = holds(q.parts[0])
            for p in q.parts[1:]:
                out = (out & holds(p)) if isinstance(q, And) else (out | holds(p))
            return out
        return F.col(f"leaf{leaves.index(q)}")

    return flags.where(holds(query)).select("doc_id")


def like(text: Column, query) -> Column:
    """The query as substrings of the text, case-sensitive: the scan baseline."""
    if isinstance(query, Term):
        return F.contains(text, F.lit(query.word))
    if isinstance(query, Phrase):
        return F.contains(text, F.lit(" ".join(query.words)))
    if isinstance(query, Not):
        return ~like(text, query.part)
    parts = [like(text, p) for p in query.parts]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if isinstance(query, And) else (out | p)
    return out


def bm25(index: Index, terms: list[str], weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id and score: for each term the best weighted field, summed over terms.
    Lengths and document counts are per field."""
    tf = index.postings.where(F.col("term").isin(*terms)).select("term", "field", "doc_id", F.size("pos").alias("tf"), "dl")
    df = tf.groupBy("term", "field").agg(F.count("*").alias("df"))  # a row for each term asked and field
    x = tf.join(F.broadcast(df), ["term", "field"]).join(F.broadcast(index.sizes), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    boost = F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))[F.col("field")]
    per_term = x.groupBy("doc_id", "term").agg(F.max(s * boost).alias("s"))
    return per_term.groupBy("doc_id").agg(F.sum("s").alias("score"))


def cover_density(index: Index, words: tuple[str, ...], weights: dict[str, float]) -> DataFrame:
    """doc_id and score of documents that hold all the words, by cover density: a
    cover is a stretch of places of a field's words that holds all of them and no
    smaller stretch that does. It counts the harmonic mean of its words' weights,
    divided by one more than the other places in it. Documents are ranked by the sum
    of their covers; a single word's covers are its places."""
    w = F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))[F.col("field")]
    hits = index.postings.where(F.col("term").isin(*words))
    if len(words) == 1:
        return hits.groupBy("doc_id").agg(F.sum(w * F.size("pos")).alias("score"))
    word = F.create_map(*(y for k, x in enumerate(words) for y in (F.lit(x), F.lit(k))))[F.col("term")]
    places = hits.select("doc_id", "field", word.alias("k"), F.explode("pos").alias("pos"))
    # a cover ends at a place: it begins at the least of the last places of all words up to there
    upto = W.partitionBy("doc_id", "field").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("k") == k, F.col("pos"))).over(upto) for k in range(len(words))]
    ended = places.select("doc_id", "field", "pos", F.when(F.array_contains(F.array(*(x.isNotNull() for x in last)), False), None).otherwise(F.least(*last)).alias("begin"))
    # of ends with the same beginning the first is the smallest cover
    covers = ended.where("begin is not null").groupBy("doc_id", "field", "begin").agg(F.min("pos").alias("end"))
    other = F.col("end") - F.col("begin") + 1 - len(words)
    return covers.groupBy("doc_id").agg(F.sum(w / (1 + F.greatest(other, F.lit(0)))).alias("score"))


def top(scored: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k best; ties by key."""
    return scored.orderBy(F.desc("score"), key).limit(k)


def collapsed_top(scored: DataFrame, group: str, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k best of the best row of each group."""
    best = scored.groupBy(group).agg(F.min_by(F.struct(*scored.columns), F.struct(-F.col("score"), F.col(key))).alias("x")).select("x.*")
    return top(best, k, key)


def facets(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each column's values in one pass (grouping sets)."""
    names = [f"_f{i}" for i in range(len(columns))]
    base = docs.select(*(F.col(c).cast("string").alias(n) for c, n in zip(columns, names, strict=True)))
    grouped = base.groupingSets([[n] for n in names], *names).agg(F.count("*").alias("n"), *(F.grouping(n).alias(f"g{n}") for n in names))
    facet = F.coalesce(*(F.when(F.col(f"g{n}") == 0, c) for c, n in zip(columns, names, strict=True)))
    return grouped.select(facet.alias("facet"), F.coalesce(*names).alias("value"), "n")


def range_facet(docs: DataFrame, column: str, start: int, end: int, gap: int) -> DataFrame:
    """Counts of buckets from start to end, empty ones too."""
    buckets = docs.sparkSession.range(start, end, gap).select(F.col("id").alias("bucket"))
    place = (F.lit(start) + gap * F.floor((F.col(column) - start) / gap)).cast("long")
    counts = docs.where((F.col(column) >= start) & (F.col(column) < end)).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def fuzzy_terms(terms: DataFrame, word: str, edits: int = 2) -> DataFrame:
    """Those of the terms (each once) within so many edits, by the threshold form of
    the distance."""
    d = F.levenshtein(F.col("term"), F.lit(word), edits)
    return terms.where(F.abs(F.length("term") - len(word)) <= edits).withColumn("distance", d).where("distance >= 0")


def fuzzy_search(index: Index, word: str, edits: int = 2) -> DataFrame:
    """doc_id of documents with a term within so many edits, however many such
    terms there are."""
    near = written(fuzzy_terms(index.terms, word, edits).select("term"))
    few = near.limit(_FEW + 1).count() <= _FEW
    return index.postings.join(F.broadcast(near) if few else near, "term", "left_semi").select("doc_id").distinct()


def trigrams(c: Column) -> Column:
    """Distinct letter triples of a word with two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def word_similarity(terms: DataFrame, word: str, threshold: float = 0.6) -> DataFrame:
    """Those of the terms (each once) whose trigrams cover enough of the word's."""
    mine = trigrams(F.lit(word))
    scored = terms.select("term").withColumn("similarity", F.size(F.array_intersect(trigrams(F.col("term")), mine)) / F.size(mine))
    return scored.where(F.col("similarity") >= threshold)


def extent_similarity(query: str, title: str, threshold: float) -> float:
    """The largest share of common among all distinct trigrams of the query and of a run of the
    title's trigrams, in their order; 0 if no run reaches the threshold. A run that is best
    begins and ends with a trigram of the query, and has at most len(query's) / threshold distinct ones."""
    wanted = set(_triples(query))
    ordered = [g for w in re.findall(r"[^\W_]+", title) for g in _triples(w)]
    at = [k for k, g in enumerate(ordered) if g in wanted]
    best = 0.0
    for begin in at:
        seen: set[str] = set()
        common = 0
        for g in itertools.islice(ordered, begin, None):
            if g not in seen:
                seen.add(g)
                common += g in wanted
                if len(seen) * threshold > len(wanted):
                    break
            if g in wanted:
                best = max(best, common / (len(wanted) + len(seen) - common))
    return best if best >= threshold else 0.0


def _triples(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


def similar_titles(docs: DataFrame, column: str, word: str, threshold: float = 0.6, key: str = "doc_id") -> DataFrame:
    """key and similarity of the texts with a run of trigrams that is similar enough to the word's
    (see ``extent_similarity``). Only texts that hold enough of its trigrams are compared."""
    mine = sorted(set(_triples(word)))
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "   "), F.lit("  "))
    held = sum((F.contains(padded, F.lit(g)).cast("int") for g in mine), F.lit(0))

    @F.pandas_udf("double")
    def best(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: extent_similarity(word, t, threshold)).astype(float)

    near = docs.where(held >= threshold * len(mine) - 1e-9).select(key, best(F.lower(column)).alias("similarity"))
    return near.where("similarity > 0")


def best_fragments(index: Index, texts: DataFrame, words: tuple[str, ...], least: int = 12, most: int = 25) -> DataFrame:
    """doc_id, field, n (its hits) and fragment of texts (doc_id, field, text): the run of ``least`` to
    ``most`` words with most distinct hits, then most hits, then the shortest and the first one; hits are marked
    with <em>. Places come from the index, the text is only cut. A run of too few words goes on to the
    right, at the end of the text to the left; a text without hits gives its first words."""
    key = ["doc_id", "field"]
    hits = index.postings.where(F.col("term").isin(*words)).join(texts.select(*key), key, "left_semi")
    hits = hits.select(*key, "term", F.explode("pos").alias("pos"))
    within = W.partitionBy(*key).orderBy("pos").rangeBetween(0, most - 1)
    runs = hits.select(*key, "pos", F.size(F.collect_set("term").over(within)).alias("terms"), F.count("*").over(within).alias("n"), F.max("pos").over(within).alias("last"))
    order = F.struct(-F.col("terms"), -F.col("n"), F.col("last") - F.col("pos"), F.col("pos"))
    best = runs.groupBy(*key).agg(F.min_by(F.struct("pos", "last", "n"), order).alias("run"), F.collect_set("pos").alias("hits"))
    parts = F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{N}]+[^\p{L}\p{N}]*)"), 1)
    cut = texts.select(*key, parts.alias("parts")).join(best, key, "left")
    stop = F.least(F.greatest(F.coalesce("run.last", F.lit(0)) + 1, F.coalesce("run.pos", F.lit(0)) + least), F.size("parts"))
    begin = F.greatest(F.least(F.coalesce("run.pos", F.lit(0)), stop - least), F.lit(0))
    cut = cut.select(*key, "parts", "hits", F.coalesce("run.n", F.lit(0)).alias("n"), begin.alias("begin"), stop.alias("stop"))
    marked = F.transform(F.slice("parts", F.col("begin") + 1, F.col("stop") - F.col("begin")), lambda w, i: F.when(F.array_contains(F.coalesce("hits", F.array().cast("array<int>")), i + F.col("begin")), F.regexp_replace(w, r"^([\p{L}\p{N}]+)", "<em>$1</em>")).otherwise(w))
    return cut.select(*key, "n", F.regexp_replace(F.array_join(marked, ""), r"[^\p{L}\p{N}>]+$", "").alias("fragment"))


def overlap(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many keys two results share."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared"))
