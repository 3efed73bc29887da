"""n-gram language models as count tables: maximum likelihood, Laplace, and
interpolated Kneser-Ney, scored by joins.

``sentences`` are rows (sid, t) with token arrays. Counts are rows (k, ctx, w, c):
every position at or after n - 1 of the padded sentence counts its k-gram, so
the start mark is never predicted. Contexts are texts joined by a blank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import joined_ngrams
from ..sources.stored import written
from .tokens import each

BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def padded(sentences: DataFrame, n: int) -> DataFrame:
    """n - 1 start marks before and an end mark after each sentence."""
    return sentences.withColumn("t", F.concat(F.array_repeat(F.lit(BOS), n - 1), "t", F.array(F.lit(EOS))))


def contexts(sentences: DataFrame, n: int, k: int) -> DataFrame:
    """(sid, i, ctx, w): each predicted token and its k - 1 tokens before."""
    rows = padded(sentences, n).select("sid", F.col("t"), F.explode(F.sequence(F.lit(n), F.size("t"))).alias("i"))
    return rows.where("i >= " + str(n)).select("sid", "i", F.array_join(F.slice("t", F.col("i") - (k - 1), k - 1), " ").alias("ctx"), F.element_at("t", F.col("i")).alias("w"))


def counts(sentences: DataFrame, n: int) -> DataFrame:
    """(k, ctx, w, c) for k = 1..n."""
    out = None
    for k in range(1, n + 1):
        part = contexts(sentences, n, k).groupBy("ctx", "w").agg(F.count("*").alias("c")).select(F.lit(k).alias("k"), "ctx", "w", "c")
        out = part if out is None else out.unionAll(part)
    return out


def vocabulary(sentences: DataFrame, min_count: int = 2) -> DataFrame:
    """Words that occur often enough."""
    return sentences.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= min_count).select("w")


def apply_vocabulary(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Words outside the vocabulary become <unk>; order is kept by places."""
    rows = sentences.select("sid", F.posexplode("t").alias("pos", "w"))
    known = rows.join(words.withColumn("known", F.lit(True)), "w", "left").withColumn("w", F.when(F.col("known"), F.col("w")).otherwise(UNK))
    return known.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("x")).select("sid", F.transform("x", lambda x: x["w"]).alias("t"))


def _context_sums(table: DataFrame) -> DataFrame:
    return table.groupBy("ctx").agg(F.sum("c").alias("total"), F.count("*").alias("types"))


def score(train: DataFrame, test: DataFrame, n: int, method: str = "kn", discount: float = 0.75) -> DataFrame:
    """(sid, i, w, p) of every token of test (end marks too)."""
    model = counts(train, n)
    v = model.where("k = 1").select("w").distinct().agg(F.count("*").alias("v"))
    rows = contexts(test, n, n)
    if method in ("mle", "laplace"):
        top = model.where(F.col("k") == n)
        joined = rows.join(top.select("ctx", "w", "c"), ["ctx", "w"], "left").join(_context_sums(top), "ctx", "left").join(F.broadcast(v))
        c, total = F.coalesce("c", F.lit(0)), F.coalesce("total", F.lit(0))
        p = F.when(total > 0, c / total).otherwise(0.0) if method == "mle" else (c + 1) / (total + F.col("v"))
        return joined.select("sid", "i", "w", p.alias("p"))
    scored = _interpolated(model, rows.select("ctx", "w").distinct(), n, [discount]).select("ctx", "w", "p")
    return rows.join(scored, ["ctx", "w"]).select("sid", "i", "w", "p")


def _interpolated(model: DataFrame, asked: DataFrame, n: int, discounts: list[float]) -> DataFrame:
    """asked (distinct ctx and w, and other columns) with discount and p, interpolated Kneser-Ney: from
    the lowest order up, each order's counts meet the asked pairs once for all discounts."""
    v = model.where("k = 1").select("w").distinct().agg(F.count("*").alias("v"))
    rows = asked.join(F.broadcast(v)).withColumn("ps", F.transform(F.array(*map(F.lit, discounts)), lambda d: F.struct(d.alias("discount"), F.lit(None).cast("double").alias("p"))))
    for k in range(1, n + 1):
        if k == n:
            table = model.where(F.col("k") == n).select(F.col("ctx").alias("of"), F.col("w").alias("follows"), "c")
        else:  # in how many contexts of one more word does (ctx, w) occur
            table = model.where(F.col("k") == k + 1).select(F.when(F.lit(k) == 1, F.lit("")).otherwise(F.expr("substring(ctx, instr(ctx, ' ') + 1)")).alias("of"), F.col("w").alias("follows")).groupBy("of", "follows").agg(F.count("*").alias("c"))
        sums = table.groupBy(F.col("of").alias("back")).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        back = F.lit("") if k == 1 else F.col("ctx") if k == n else F.array_join(F.slice(F.split("ctx", " "), n - k + 1, k), " ")
        here = rows.withColumn("back", back).join(table, (F.col("w") == F.col("follows")) & (F.col("back") == F.col("of")), "left").drop("of", "follows")
        here = here.join(F.broadcast(sums) if k == 1 else sums, "back", "left")

        def with_order(x: Column) -> Column:
            gain = F.greatest(F.coalesce("c", F.lit(0)) - x["discount"], F.lit(0.0)) / F.col("total")
            share = x["discount"] * F.col("types") / F.col("total")
            p = gain + share / F.col("v") if k == 1 else F.when(F.col("total").isNull(), x["p"]).otherwise(gain + share * x["p"])
            return F.struct(x["discount"].alias("discount"), p.alias("p"))

        rows = here.withColumn("ps", F.transform("ps", with_order)).drop("back", "c", "total", "types")
    return rows.select(*asked.columns, F.explode("ps").alias("x")).select(*asked.columns, "x.*")


def smoothed_perplexity(train: DataFrame, test: DataFrame, n: int, discounts: list[float]) -> DataFrame:
    """discount, perplexity, tokens and zero tokens: the distinct pairs of the test set are scored once."""
    asked = contexts(test, n, n).groupBy("ctx", "w").agg(F.count("*").alias("times"))
    scored = _interpolated(counts(train, n), asked, n, discounts)
    zero = F.sum(F.when(F.col("p") <= 0, F.col("times")).otherwise(0))
    bits = F.sum(F.when(F.col("p") > 0, F.log2("p") * F.col("times")))
    return scored.groupBy("discount").agg(F.when(zero > 0, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), -bits / F.sum("times"))).alias("perplexity"), F.sum("times").alias("tokens"), zero.alias("zero_tokens"))


def perplexity(scored: DataFrame) -> DataFrame:
    """perplexity (infinite if a token has no chance), tokens and zero tokens."""
    zero = F.count_if(F.col("p") <= 0)
    bits = F.sum(F.when(F.col("p") > 0, F.log2("p")))
    return scored.agg(F.when(zero > 0, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), -bits / F.count("*"))).alias("perplexity"), F.count("*").alias("tokens"), zero.alias("zero_tokens"))


def next_words(train: DataFrame, context: str, n: int, temperature: float = 1.0, top_k: int | None = None, banned: tuple[str, ...] = (UNK,)) -> DataFrame:
    """(w, p) after a context by maximum likelihood, without banned words, cut to
    the top_k likeliest, sharpened by the temperature and summing to one."""
    rows = counts(train, n).where((F.col("k") == n) & (F.col("ctx") == context) & ~F.col("w").isin(*banned))
    if top_k is not None:
        rows = rows.orderBy(F.desc("c"), "w").limit(top_k)
    powered = rows.select("w", F.pow(F.col("c").cast("double"), F.lit(1.0 / temperature)).alias("x"))
    return powered.join(F.broadcast(powered.agg(F.sum("x").alias("s")))).select("w", (F.col("x") / F.col("s")).alias("p"))


def chance(seed: int, *parts: str) -> Column:
    """A number in [0, 1) from a hash of the seed and the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / (1 << 32)


@dataclass(frozen=True)
class Successors:
    """What may follow each context: a successor holds a part [lo, hi) of [0, 1), in the order of
    the words. A context has as many buckets as successors, and a text meets those of one
    bucket, so a context that all texts share is no product."""

    n: int
    parts: DataFrame
    known: DataFrame


def successors(train: DataFrame, n: int) -> Successors:
    """The maximum-likelihood model of order n; written."""
    table = counts(train, n).where(F.col("k") == n)
    upto = W.partitionBy("ctx").orderBy("w")
    parts = table.select("ctx", "w", F.sum("c").over(upto).alias("hi"), "c", F.sum("c").over(W.partitionBy("ctx")).alias("total"), F.count("*").over(W.partitionBy("ctx")).alias("buckets"))
    parts = parts.select("ctx", "w", "buckets", ((F.col("hi") - F.col("c")) / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi"))
    parts = written(parts.select("ctx", "w", "lo", "hi", "buckets", F.explode(F.sequence(_bucket("lo"), _bucket("hi"))).alias("bucket")))
    return Successors(n, parts.drop("buckets"), written(parts.groupBy("ctx").agg(F.max("buckets").alias("buckets"))))


def _bucket(x: str) -> Column:
    return F.least(F.floor(F.col(x) * F.col("buckets")), F.col("buckets") - 1)


#: Places that are drawn in one job.
_PLACES = 10


def draw(model: Successors, starts: DataFrame, words: int, seed: int) -> DataFrame:
    """text and t (its words) for each text of ``starts``: all texts at once, a join for each place."""
    last = max(model.n - 1, 1)
    follow = model.parts.select(F.col("ctx").alias("of"), F.col("bucket").alias("part"), "w", "lo", "hi")
    now = starts.select("text", F.lit(" ".join([BOS] * (model.n - 1))).alias("ctx"), F.array().cast("array<string>").alias("t"), F.lit(True).alias("open"))
    for pos in range(words):
        drawn = now.withColumn("pos", F.lit(pos)).join(model.known, "ctx", "left").withColumn("u", chance(seed, "text", "pos"))
        drawn = drawn.withColumn("bucket", F.when(F.col("open"), _bucket("u"))).drop("pos", "buckets")
        met = drawn.join(follow, (F.col("ctx") == F.col("of")) & (F.col("bucket") == F.col("part")) & (F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi")), "left")
        goes = F.col("open") & F.col("w").isNotNull() & (F.col("w") != EOS)
        ctx = F.expr(f"array_join(slice(split(concat_ws(' ', nullif(ctx, ''), w), ' '), -{last}, {last}), ' ')") if model.n > 1 else F.lit("")
        now = met.select("text", F.when(goes, ctx).otherwise("").alias("ctx"), F.when(goes, F.concat("t", F.array("w"))).otherwise(F.col("t")).alias("t"), goes.alias("open"))
        if pos % _PLACES == _PLACES - 1:
            now = written(now)
    return now.select("text", "t")


def generate(train: DataFrame, n: int, texts: int, words: int, seed: int = 1) -> DataFrame:
    """(text, pos, w): words drawn from the maximum-likelihood model."""
    starts = train.sparkSession.range(texts).select(F.col("id").alias("text"))
    return draw(successors(train, n), starts, words, seed).select("text", F.posexplode("t").alias("pos", "w"))


def copies(drawn: DataFrame, source: DataFrame, share: float, most: int) -> DataFrame:
    """text of those (text, t) that hold a run of more than ``share`` of their words, or of more than
    ``most``, that the source (sid, t) has too; or that stand there whole. Only the lengths that occur are cut from the source."""
    longer = F.least(F.round(F.size("t") * F.lit(share)).cast("int"), F.lit(most)) + 1
    rows = drawn.where(F.size("t") > 0).select("text", "t", F.least(longer, F.size("t")).alias("n"))
    asked = rows.select("text", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1), lambda i: F.array_join(F.slice("t", i, F.col("n")), " "))).alias("gram"))
    asked = written(asked)
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # at most one for each length of a text
    if not lengths:
        return asked.select("text")
    at = source.where(F.size("t") > 0).select("t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i"))
    cut = at.select("t", "i", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.col("i") + F.col("n") - 1 <= F.size("t"))
    seen = cut.select("n", F.array_join(F.slice("t", F.col("i"), F.col("n")), " ").alias("gram"))
    # the drawn runs are few beside the source's: they reduce those first
    met = seen.join(asked.select("n", "gram").distinct(), ["n", "gram"], "left_semi").distinct()
    return asked.join(met, ["n", "gram"], "left_semi").select("text").distinct()


def generate_original(train: DataFrame, n: int, texts: int, words: int, share: float = 0.7, most: int = 15, tries: int = 10, seed: int = 1, least: int = 1) -> DataFrame:
    """text, tries (that it took) and t: texts of ``least`` words or more of which none copies a long run of
    the source (see ``copies``). Those that do are drawn again, all at once, up to ``tries`` times; texts that
    never pass are left out."""
    model = successors(train, n)
    left = train.sparkSession.range(texts).select(F.col("id").alias("text"))
    out = None
    for k in range(tries):
        drawn = written(draw(model, left, words, seed + 7919 * k))
        bad = written(copies(drawn, train, share, most).unionAll(drawn.where(F.size("t") < least).select("text")).distinct())
        passed = drawn.join(bad, "text", "left_anti").select("text", F.lit(k + 1).alias("tries"), "t")
        out = passed if out is None else out.unionAll(passed)
        left = bad
        if left.isEmpty():
            break
    return out


def grams(units: DataFrame, n: int) -> DataFrame:
    """(sid, gram) of every run of n tokens."""
    return each(units, joined_ngrams(F.col("t"), n), "gram", "sid")


def copied(generated: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """total n-grams of the generated units and the share that the source has."""
    seen = grams(source, n).select("gram").distinct().withColumn("hit", F.lit(1))
    return grams(generated, n).join(seen, "gram", "left").agg(F.count("*").alias("total"), (F.count("hit") / F.count("*")).alias("ratio"))


#: Runs that are broadcast at most.
_RUNS = 200_000


def longest_copied(generated: DataFrame, source: DataFrame, most: int = 12) -> DataFrame:
    """The largest n up to ``most`` with a run that the source has. The beginning of a run that the source has
    is one too, so the longest length is tried first and then the middle of what is left: a
    scan makes the runs of one length, and there are few scans."""
    low, high, n = 0, most, most  # the source has a run of low tokens, and none of more than high
    while low < high:
        asked = written(grams(generated, n).select("gram").distinct())
        met = grams(source, n).join(F.broadcast(asked) if asked.count() <= _RUNS else asked, "gram", "left_semi")
        low, high = (n, high) if met.count() else (low, n - 1)
        n = (low + high + 1) // 2
    return generated.sparkSession.range(1).select(F.lit(low).alias("longest"))
