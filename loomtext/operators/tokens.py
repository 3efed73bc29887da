"""Token and n-gram statistics, stem comparisons and subword units."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..sources.stored import written
from .ranking import ranked


def each(df: DataFrame, elements: Column, name: str, *keep: str) -> DataFrame:
    """One row per element. Not explode: the size test that Spark would push
    below it computes costly arrays twice, and once for each run inside a lambda."""
    return df.select(*keep, F.explode_outer(elements).alias(name)).where(F.col(name).isNotNull())


def token_rows(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """One row per token with its place (from 0)."""
    return df.select(*keep, F.posexplode(tokens).alias("pos", "w"))


def gram_counts(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """gram (joined by spaces) and c over all rows; counted map-side first."""
    return each(df.select(tokens.alias("_t")), X.joined_ngrams(F.col("_t"), n), "gram").groupBy("gram").agg(F.count("*").alias("c"))


def content_grams(df: DataFrame, tokens: Column, n: int, stop: tuple[str, ...] = X.STOP_WORDS, drop_if: str = "any") -> DataFrame:
    """Gram counts without those in which any (or all) words are stop words."""
    rows = each(df.select(tokens.alias("_t")), X.ngrams(F.col("_t"), n), "g")
    test = F.exists if drop_if == "any" else F.forall
    return rows.where(~test("g", lambda w: w.isin(*stop))).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("c"))


def top_grams(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent; ties by the gram itself (a documented choice)."""
    return counts.orderBy(F.desc("c"), "gram").limit(k)


def distribution(counts: DataFrame) -> DataFrame:
    """total, uniques, hapax share, share of the ten most frequent, largest."""
    top = counts.orderBy(F.desc("c"), "gram").limit(10).agg(F.sum("c").alias("top10"))
    sums = counts.agg(F.sum("c").alias("total"), F.count("*").alias("uniques"), F.count_if(F.col("c") == 1).alias("hapax"), F.max("c").alias("largest"))
    return sums.join(top).select("total", "uniques", (F.col("hapax") / F.col("uniques")).alias("hapax_share"), (F.col("top10") / F.col("total")).alias("top10_share"), "largest")


def rank_frequency(counts: DataFrame) -> DataFrame:
    """gram, c and rank by falling count, then by the first two letters and the whole gram."""
    return ranked(counts, [-F.col("c"), F.substring("gram", 1, 2), "gram"])


def successors(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """(w, next) pairs of neighbouring tokens."""
    return each(df.select(*keep, tokens.alias("_t")), X.ngrams(F.col("_t"), 2), "g", *keep).select(*keep, F.col("g")[0].alias("w"), F.col("g")[1].alias("next"))


def stem_disagreements(stems: DataFrame, a: str = "porter", b: str = "snowball") -> DataFrame:
    """Words with different stems."""
    return stems.where(F.col(a) != F.col(b)).select("w", a, b)


def over_stemmed(stems: DataFrame, stem: str, lemma: str) -> DataFrame:
    """Stems that gather several lemmas of which none begins another."""
    groups = stems.groupBy(stem).agg(F.sort_array(F.collect_set(lemma)).alias("lemmas")).where(F.size("lemmas") > 1)
    related = F.exists("lemmas", lambda a: F.exists("lemmas", lambda b: (a != b) & F.startswith(b, a)))
    return groups.where(~related)


def under_stemmed(stems: DataFrame, stem: str, lemma: str) -> DataFrame:
    """Lemmas whose words have several stems."""
    return stems.groupBy(lemma).agg(F.countDistinct(stem).alias("n"), F.array_join(F.sort_array(F.collect_set(stem)), ",").alias("stems")).where("n > 1")


#: Pairs that one count brings back.
_LEADING = 64


def _merged(symbols: Column, pair: tuple[str, str]) -> Column:
    """The symbols with every occurrence of the pair, from the left, as one."""
    a, b = (F.lit(x) for x in pair)

    def step(done, x):
        joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1) == a) & (x == b)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(a, b)))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(symbols, F.array().cast("array<string>"), step)


def train_bpe(words: DataFrame, merges: int) -> list[tuple[str, str]]:
    """Byte-pair merges of a vocabulary (word, c); ties: the first pair in the pairs'
    own order. Neighbouring symbols are counted over all words by Spark, and only the
    leading pairs come back. Of these, as many are merged at once as are sure to
    follow one another: a merge changes only counts of pairs with its symbols, and
    can't lift one above what such a pair had before."""
    now = written(words.select(F.filter(F.split("word", ""), lambda x: x != "").alias("s"), "c"))
    out: list[tuple[str, str]] = []
    while len(out) < merges:
        pairs = now.select("c", F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b"))).alias("p"))
        rows = pairs.groupBy("p").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "p").limit(_LEADING).collect()
        if not rows:
            break
        used: set[str] = set()
        batch: list[tuple[str, str]] = []
        for k, r in enumerate(rows[: merges - len(out)]):
            pair = (r["p"][0], r["p"][1])
            touched = next((x["n"] for x in rows[k:] if used & {*x["p"]}), 0 if len(rows) < _LEADING else rows[-1]["n"])
            if batch and (used & {*pair} or touched >= r["n"]):
                break
            batch.append(pair)
            used |= {*pair, "".join(pair)}
        out += batch
        for pair in batch:
            now = now.withColumn("s", _merged(F.col("s"), pair))
        now = written(now.where(F.size("s") > 1))
    return out


def merge_pair(symbols: tuple[str, ...], pair: tuple[str, str]) -> tuple[str, ...]:
    """The symbols with every occurrence of the pair as one."""
    out, i = [], 0
    while i < len(symbols):
        step = 2 if symbols[i : i + 2] == pair else 1
        out.append("".join(symbols[i : i + step]))
        i += step
    return tuple(out)


def apply_bpe(words: DataFrame, column: str, merges: list[tuple[str, str]]) -> DataFrame:
    """Adds ``pieces``: each word after the merges, in their order."""

    @F.pandas_udf("array<string>")
    def run(ws: pd.Series) -> pd.Series:
        def one(w):
            t = tuple(w or "")
            for pair in merges:
                if len(t) > 1:
                    t = merge_pair(t, pair)
            return list(t)

        return ws.map(one)

    return words.withColumn("pieces", run(F.col(column)))


def variant_stats(variants: DataFrame, base: str) -> DataFrame:
    """units, vocabulary, type-token ratio and vocabulary change in percent
    against the base variant, from rows (variant, unit)."""
    stats = variants.groupBy("variant").agg(F.count("*").alias("units"), F.countDistinct("unit").alias("vocabulary"))
    ref = stats.where(F.col("variant") == base).select(F.col("vocabulary").alias("base"), F.col("units").alias("words"))
    return stats.join(F.broadcast(ref)).select("variant", "units", "vocabulary", (F.col("vocabulary") / F.col("units")).alias("ttr"), (F.col("units") / F.col("words")).alias("per_word"), ((F.col("vocabulary") / F.col("base") - 1) * 100).alias("change"))


#: Keys of phrases that are broadcast at most.
_KEYS = 200_000


def first_sentence_with(sentences: DataFrame, phrases: DataFrame) -> DataFrame:
    """For each phrase the first sentence (doc_id, pos) that contains it.

    A phrase's words between its first and last blank stand whole and side by side in every sentence
    that holds it, so phrase and sentence meet at the longest two of them that are neighbours (or the only one). For a
    phrase of one or two words, the distinct words of all sentences that have the longer one inside are
    found by its first 16, 8, 4, 2 or 1 letters, and the sentences with such a word are met in the same scan."""
    parts = F.split("phrase", " ")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = lambda ws: F.array_max(F.transform(F.filter(ws, lambda w: F.trim(w) != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = phrases.where("phrase is not null").select("phrase", inner.alias("inner"), longest(parts).alias("piece"))
    keyed = written(keyed.select("phrase", longest(F.when(F.size("inner") > 1, X.joined_ngrams(F.col("inner"), 2)).otherwise(F.col("inner"))).alias("whole"), "piece"))
    lines = sentences.select("doc_id", "pos", "sentence", F.split("sentence", " ").alias("p"))
    keys = keyed.where("whole is not null").select("phrase", F.col("whole").alias("w"))
    size = F.length("piece")
    short = keyed.where("whole is null and piece is not null").select("phrase", "piece", F.substring("piece", F.lit(1), F.when(size >= 16, 16).when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)).alias("begin"))
    lengths = sorted(r[0] for r in short.select(F.length("begin")).distinct().collect())
    if lengths:
        own = written(each(lines, F.array_distinct("p"), "w").select("w").distinct())
        cut = own.select("w", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.length("w") >= F.col("n"))
        pieces = F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substring("w", i, F.col("n")))
        met = each(cut, pieces, "begin", "w").join(F.broadcast(short) if short.count() <= _KEYS else short, "begin").where(F.contains("w", "piece"))
        keys = keys.unionByName(met.select("phrase", "w").distinct())
    keys = written(keys)
    runs = each(lines, F.array_distinct(F.concat("p", X.joined_ngrams(F.col("p"), 2))), "w", "doc_id", "pos", "sentence")
    hits = runs.join(F.broadcast(keys) if keys.count() <= _KEYS else keys, "w")
    place = F.struct("doc_id", "pos")
    found = hits.where(F.contains("sentence", "phrase")).groupBy("phrase").agg(F.min_by("sentence", place).alias("sentence"))
    # phrases of blanks alone (and the empty one): as many as there are lengths
    for blank in sorted(r[0] for r in keyed.where("piece is null").select("phrase").distinct().collect()):
        first = sentences.where(F.contains("sentence", F.lit(blank))).agg(F.min_by("sentence", place).alias("sentence"))
        found = found.unionByName(first.where("sentence is not null").select(F.lit(blank).alias("phrase"), "sentence"))
    return found


def variant_counts(variants: DataFrame, base: str) -> DataFrame:
    """variant_stats from counts (variant, unit, c)."""
    stats = variants.groupBy("variant", "unit").agg(F.sum("c").alias("c")).groupBy("variant").agg(F.sum("c").alias("units"), F.count("*").alias("vocabulary"))
    ref = stats.where(F.col("variant") == base).select(F.col("vocabulary").alias("base"), F.col("units").alias("words"))
    return stats.join(F.broadcast(ref)).select("variant", "units", "vocabulary", (F.col("vocabulary") / F.col("units")).alias("ttr"), (F.col("units") / F.col("words")).alias("per_word"), ((F.col("vocabulary") / F.col("base") - 1) * 100).alias("change"))


def near_pairs(texts: DataFrame, column: str, edits: int) -> DataFrame:
    """a, b (a < b) and distance of the distinct texts within so many edits. Two such texts give an
    equal one when at most ``edits`` letters are deleted from each, so they meet at it: no
    pair is compared that doesn't, and none is missed. For names: a text of n letters has about n^edits of these."""
    own = texts.select(F.col(column).alias("t")).where(F.col(column).isNotNull()).distinct()

    def shorter(t: Column) -> Column:
        return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))

    kept = own.select("t", F.array("t").alias("v"), F.array("t").alias("last"))
    for _ in range(edits):
        kept = kept.withColumn("last", F.array_distinct(F.flatten(F.transform("last", shorter)))).withColumn("v", F.concat("v", "last"))
    met = written(kept.select("t", F.explode(F.array_distinct("v")).alias("v")))
    pairs = met.select(F.col("t").alias("a"), "v").join(met.select(F.col("t").alias("b"), "v"), "v").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", edits)).where("distance >= 0")


def song_lines(lines: DataFrame, own: str) -> DataFrame:
    """Lines (song, pos, line) without section headers and without the verses
    that a header gives to someone else; the header's decision holds until the
    next header of the song."""
    header = F.regexp_extract("line", r"^\s*\[([^\]]*)\]\s*$", 1)
    who = F.trim(F.regexp_extract(header, r":(.*)$", 1))
    decision = F.when(header != "", (who == "") | F.contains(who, F.lit(own)))
    upto = W.partitionBy("song").orderBy("pos")
    marked = lines.withColumn("_header", header != "").withColumn("_keep", F.coalesce(F.last(decision, True).over(upto), F.lit(True)))
    return marked.where("_keep and not _header and trim(line) <> ''").select("song", "pos", F.trim("line").alias("line"))


def distinct_songs(lines: DataFrame) -> DataFrame:
    """Songs whose first four lines aren't those of an earlier song, and of
    equal lines the first."""
    own = lines.withColumn("_rn", F.row_number().over(W.partitionBy("song", F.lower("line")).orderBy("pos"))).where("_rn = 1").drop("_rn")
    first = own.withColumn("_n", F.row_number().over(W.partitionBy("song").orderBy("pos"))).where("_n <= 4").groupBy("song").agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")).alias("print"))
    kept = first.groupBy("print").agg(F.min("song").alias("song"))
    rows = own.join(kept.select("song"), "song", "left_semi")
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(F.lower("line")).orderBy("song", "pos"))).where("_rn = 1").drop("_rn")
