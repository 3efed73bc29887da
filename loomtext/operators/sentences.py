"""Sentences by abbreviations that are learned from the corpus itself, without labels.

The measures are those of Kiss and Strunk (2006), as aggregates over counts of word types:

* ``facts``: one scan counts each type with and without a final period, in upper and
  lower case, and each pair of a type that ends with a mark and the type after it.
* ``abbreviations``: a type is one if a period follows it more surely than by chance (the
  log-likelihood ratio of 0.99 against the share of periods), weighted by its length, its
  inner periods and how often it stands without one.
* ``starters`` and ``collocations``: types that stand after sure ends, and pairs across a period,
  far more often than by chance.
* ``joined_pairs``: the pairs whose period ends no sentence, decided from the above
  and from the case in which the second type stands elsewhere. They are all that the second scan
  needs to cut the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.stored import written

#: What opens and closes around words.
_CLOSING = r"""["')\]}»”’]*\z"""
#: White space, with the no-break space.
_SPACE = "[ \\t\\n\\r\\f\\x0B\u00a0]+"
#: The published thresholds.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Rows of a few words that are broadcast at most.
_SMALL = 200_000


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def kind(token: Column) -> Column:
    """How a token ends: hard (! or ?), dot, or null."""
    return F.when(token.rlike(r"[!?]" + _CLOSING), "hard").when(token.rlike(r"\." + _CLOSING), "dot")


def plain(token: Column) -> Column:
    """The token without what stands around its letters and digits."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")


def word_type(token: Column) -> Column:
    """The lower-case type; numbers are one type."""
    w = plain(token)
    return F.when(w.rlike(r"^\p{N}[\p{N}.,]*$"), "##number##").otherwise(F.lower(w))


def capital(token: Column) -> Column:
    return plain(token).rlike(r"^\p{Lu}")


def facts(docs: DataFrame, column: str = "text") -> DataFrame:
    """what, w, next, upper and c. ``what``: word (``next`` is "." if a period follows), dot
    and hard (w ends so, next follows), start (next begins a text). upper: the case of w, or of next in pairs."""
    t = docs.select(_tokens(F.col(column)).alias("t"))
    t = t.select(F.explode_outer(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, 1 << 30).alias("b"), F.transform("t", lambda _, i: i).alias("i"))).alias("x"))
    # what follows counts only after a mark: equal tokens, and such pairs, are looked at once
    t = t.where("x.a is not null").select("x.a", F.when(F.col("x.a").rlike("[.!?]"), F.col("x.b")).alias("b"), (F.col("x.i") == 0).alias("begins"))
    t = t.groupBy("a", "b", "begins").agg(F.count("*").alias("n"))
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    fact = lambda what, w, nxt, upper: F.struct(F.lit(what).alias("what") if isinstance(what, str) else what.alias("what"), w.alias("w"), nxt.alias("next"), upper.alias("upper"))
    word = fact("word", word_type(a), F.when(k == "dot", ".").otherwise(""), capital(a))
    pair = F.when(k.isNotNull() & b.isNotNull(), fact(k, word_type(a), word_type(b), capital(b)))
    first = F.when(F.col("begins"), fact("start", F.lit(""), word_type(a), capital(a)))
    rows = t.withColumn("k", kind(a)).select("n", F.explode(F.array_compact(F.array(word, pair, first))).alias("f")).select("f.*", "n")
    return rows.groupBy("what", "w", "next", "upper").agg(F.sum("n").alias("c"))


def types(facts: DataFrame) -> DataFrame:
    """w, c, dots (with a period after it), lower and upper, and upper_inside: in upper
    case neither at the beginning of a text nor after a mark."""
    words = facts.where("what = 'word' and w <> ''").groupBy("w").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("next") == ".", F.col("c")).otherwise(0)).alias("dots"), F.sum(F.when(F.col("upper"), 0).otherwise(F.col("c"))).alias("lower"), F.sum(F.when(F.col("upper"), F.col("c")).otherwise(0)).alias("upper"))
    begun = facts.where("what <> 'word' and upper").groupBy(F.col("next").alias("w")).agg(F.sum("c").alias("begun"))
    return words.join(begun, "w", "left").select("w", "c", "dots", "lower", "upper", (F.col("upper") - F.coalesce("begun", F.lit(0))).alias("upper_inside"))


def _binomial(hits: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of so many hits in n; 0 for a p that allows no other outcome."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(hits * F.ln(p) + (n - hits) * F.ln(1 - p))


def likelihood_ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """-2 log of the ratio that b follows a as often as it follows anything (Dunning)."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    return -2 * (_binomial(both, a, p) + _binomial(b - both, n - a, p) - _binomial(both, a, p1) - _binomial(b - both, n - a, p2))


def abbreviations(types: DataFrame) -> DataFrame:
    """w, c, dots and score of the types that ever have a period after them and hold a letter."""
    totals = types.agg(F.sum("c").alias("n"), F.sum("dots").alias("periods"))
    c, dots = F.col("c"), F.col("dots")
    p = F.col("periods") / F.col("n")
    ratio = -2 * (_binomial(dots, c, p) - (dots * F.log(F.lit(0.99)) + (c - dots) * F.log(F.lit(0.01))))
    inner = F.length("w") - F.length(F.replace("w", F.lit("."), F.lit("")))
    letters = F.length("w") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -(c - dots).cast("double"))
    rows = types.where((dots > 0) & (F.col("w") != "##number##") & F.col("w").rlike(r"\p{L}")).join(F.broadcast(totals))
    return rows.select("w", "c", "dots", score.alias("score"))


def _initial(w: Column) -> Column:
    return w.rlike(r"^\p{L}$")


def _pairs(facts: DataFrame, short: DataFrame) -> DataFrame:
    """what, w, next, upper and c of pairs; ``short`` says whether w is an abbreviation."""
    known = short.where(F.col("score") >= ABBREVIATION).select("w", F.lit(True).alias("short"))
    rows = facts.where("what in ('dot', 'hard') and next <> ''").join(_small(known), "w", "left")
    return rows.withColumn("short", F.coalesce("short", F.lit(False)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(_SMALL + 1).count() <= _SMALL else df


def _sure(pairs: DataFrame) -> DataFrame:
    """Pairs across a sure end."""
    return pairs.where((F.col("what") == "hard") | ~(F.col("short") | _initial(F.col("w")) | (F.col("w") == "##number##")))


def starters(types: DataFrame, pairs: DataFrame) -> DataFrame:
    """w and score of the types that begin sentences."""
    after = _sure(pairs).groupBy(F.col("next").alias("w")).agg(F.sum("c").alias("begun"))
    totals = types.agg(F.sum("c").alias("n")).join(_sure(pairs).agg(F.sum("c").alias("ends")))
    rows = after.join(types.select("w", "c"), "w").join(F.broadcast(totals))
    ratio = likelihood_ratio(F.col("ends"), F.col("c"), F.col("begun"), F.col("n"))
    # more often than by chance
    return rows.where((F.col("begun") * F.col("n") > F.col("c") * F.col("ends")) & (F.col("ends") < F.col("n"))).select("w", ratio.alias("score")).where(F.col("score") >= STARTER)


def collocations(types: DataFrame, pairs: DataFrame, first: DataFrame) -> DataFrame:
    """w, next and score of initials or numbers and what follows their period by
    habit; ``first``: the starters, which don't count."""
    asked = pairs.where((F.col("what") == "dot") & (_initial(F.col("w")) | (F.col("w") == "##number##")))
    both = asked.groupBy("w", "next").agg(F.sum("c").alias("both")).where("both > 1").join(first.select(F.col("w").alias("next")), "next", "left_anti")
    rows = both.join(types.select("w", F.col("c").alias("a")), "w").join(types.select(F.col("w").alias("next"), F.col("c").alias("b")), "next").join(F.broadcast(types.agg(F.sum("c").alias("n"))))
    rows = rows.where((F.col("both") * F.col("n") > F.col("a") * F.col("b")) & (F.col("a") < F.col("n")))
    return rows.select("w", "next", likelihood_ratio(F.col("a"), F.col("b"), F.col("both"), F.col("n")).alias("score")).where(F.col("score") >= COLLOCATION)


def joined_pairs(types: DataFrame, pairs: DataFrame, first: DataFrame, habits: DataFrame) -> DataFrame:
    """w, next and upper of the pairs whose period ends no sentence."""
    initial, number = _initial(F.col("w")), F.col("w") == "##number##"
    rows = pairs.where((F.col("what") == "dot") & (F.col("short") | initial | number)).select("w", "next", "upper", "short")
    rows = rows.join(types.select(F.col("w").alias("next"), "lower", "upper_inside"), "next", "left")
    rows = rows.join(first.select(F.col("w").alias("next"), F.lit(True).alias("starts")), "next", "left").join(habits.select("w", "next", F.lit(True).alias("habit")), ["w", "next"], "left")
    begins = F.col("upper") & (F.col("lower") > 0) & (F.col("upper_inside") == 0)  # elsewhere only in lower case
    ends = begins | (F.col("upper") & F.coalesce("starts", F.lit(False)))
    name = initial & F.col("upper") & (F.col("lower") == 0)
    stays = F.when(F.col("short") & ~initial, ~ends).otherwise(F.coalesce("habit", F.lit(False)) | ~F.col("upper") | (name & ~ends))
    return rows.where(stays).select("w", "next", "upper")


def learn(docs: DataFrame, column: str = "text") -> DataFrame:
    """joined_pairs of a corpus, from one scan."""
    counts = written(facts(docs, column))
    kinds = written(types(counts))
    pairs = _pairs(counts, abbreviations(kinds))
    first = written(starters(kinds, pairs))
    return written(joined_pairs(kinds, pairs, first, collocations(kinds, pairs, first)))


def ends(docs: DataFrame, joined: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and pos (from 0) of the tokens that end a sentence, except those that end the text."""
    t = docs.select(key, _tokens(F.col(column)).alias("t"))
    t = t.select(key, F.explode_outer(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, 1 << 30).alias("b"), F.transform("t", lambda _, i: i).alias("pos"))).alias("x"))
    rows = t.where("x.b is not null").select(key, "x.pos", kind(F.col("x.a")).alias("k"), F.col("x.a").alias("a"), F.col("x.b").alias("b")).where("k is not null")
    rows = rows.select(key, "pos", "k", word_type(F.col("a")).alias("w"), word_type(F.col("b")).alias("next"), capital(F.col("b")).alias("upper"))
    stays = _small(joined.select("w", "next", "upper", F.lit("dot").alias("k")))
    return rows.join(stays, ["w", "next", "upper", "k"], "left_anti").select(key, "pos")


def split(docs: DataFrame, joined: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs' key (which tells rows apart) and sentences: the tokens of each joined by spaces."""
    marks = ends(docs, joined, key, column).groupBy(key).agg(F.sort_array(F.collect_set("pos")).alias("ends"))
    t = docs.select(key, _tokens(F.col(column)).alias("t")).join(marks, key, "left")
    begin = F.concat(F.array(F.lit(-1)), F.coalesce("ends", F.array().cast("array<int>")))
    stop = F.concat(F.coalesce("ends", F.array().cast("array<int>")), F.array(F.size("t") - 1))
    spans = t.select(key, "t", F.arrays_zip(begin.alias("a"), stop.alias("b")).alias("s"))
    # whole sentences as slices of the tokens
    return spans.select(key, F.transform(F.filter("s", lambda s: s["b"] > s["a"]), lambda s: F.array_join(F.slice("t", s["a"] + 2, s["b"] - s["a"]), " ")).alias("sentences"))
