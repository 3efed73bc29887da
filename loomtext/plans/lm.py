"""Queries of n-gram language models over the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import characters, words
from ..functions.treebank import rendered
from ..operators import lm as L
from ._register import query, table

_CLEAN = r"list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_SENT = f"s AS (SELECT conv_id || '-' || turn AS sid, conv_id % 10 = 0 AS held, {_CLEAN} AS t FROM conversations), tr0 AS (SELECT sid, t FROM s WHERE NOT held AND len(t) > 0), te0 AS (SELECT sid, t FROM s WHERE held AND len(t) > 0)"
_VOC = f"{_SENT}, voc AS (SELECT w FROM (SELECT unnest(t) AS w FROM tr0) GROUP BY 1 HAVING count(*) >= 2), vl AS (SELECT list(w) AS v FROM voc), tr AS (SELECT sid, list_transform(t, lambda x: CASE WHEN list_contains(v, x) THEN x ELSE '<unk>' END) AS t FROM tr0, vl), te AS (SELECT sid, list_transform(t, lambda x: CASE WHEN list_contains(v, x) THEN x ELSE '<unk>' END) AS t FROM te0, vl)"


def _ctx(name: str, src: str, n: int, k: int) -> str:
    pad = "[" + ", ".join(["'<s>'"] * (n - 1)) + "]" if n > 1 else "CAST([] AS VARCHAR[])"
    return f"{name} AS (SELECT sid, i, array_to_string(list_slice(t, i - {k - 1}, i - 1), ' ') AS ctx, t[i] AS w FROM (SELECT sid, t, unnest(range({n}, len(t) + 1)) AS i FROM (SELECT sid, list_concat(list_concat({pad}, t), ['</s>']) AS t FROM {src})))"


def _sentences(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training and held-out sentences: every tenth conversation is held out."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("sid"), (F.col("conv_id") % 10 == 0).alias("held"), words(F.col("text")).alias("t")).where("size(t) > 0")
    return rows.where("not held").select("sid", "t"), rows.where("held").select("sid", "t")


def _mapped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    train, test = _sentences(spark, sf_dir)
    v = L.vocabulary(train)
    return L.apply_vocabulary(train, v), L.apply_vocabulary(test, v)


@query(f"WITH {_SENT}, {_ctx('a', 'tr0', 2, 1)}, {_ctx('b', 'tr0', 2, 2)} SELECT 1 AS k, ctx, w, count(*) AS c FROM a GROUP BY 2, 3 UNION ALL SELECT 2, ctx, w, count(*) FROM b GROUP BY 2, 3")
def lm_counts(spark, sf_dir):
    """L1, L2, W7."""
    return L.counts(_sentences(spark, sf_dir)[0], 2)


@query(f"WITH {_VOC} SELECT (SELECT count(*) FROM voc) AS words, (SELECT count(*) FROM (SELECT unnest(t) AS w FROM te) WHERE w = '<unk>') AS unknown, (SELECT count(*) FROM (SELECT unnest(t) AS w FROM te)) AS tokens")
def lm_vocabulary(spark, sf_dir):
    """J9, L3, L11."""
    train, test = _sentences(spark, sf_dir)
    v = L.vocabulary(train)
    rows = L.apply_vocabulary(test, v).select(F.explode("t").alias("w"))
    return v.agg(F.count("*").alias("words")).join(rows.agg(F.count_if(F.col("w") == L.UNK).alias("unknown"), F.count("*").alias("tokens")))


_TOP2 = f"{_VOC}, {_ctx('u', 'tr', 2, 1)}, {_ctx('m', 'tr', 2, 2)}, {_ctx('q', 'te', 2, 2)}, v AS (SELECT count(DISTINCT w) AS v FROM u), c AS (SELECT ctx, w, count(*) AS c FROM m GROUP BY 1, 2), n AS (SELECT ctx, sum(c) AS total, count(*) AS types FROM c GROUP BY 1)"
_PP = "CASE WHEN count(*) FILTER (p <= 0) > 0 THEN 1e300 ELSE round(pow(2, -sum(CASE WHEN p > 0 THEN log2(p) END) / count(*)), 4) END AS perplexity, count(*) AS tokens, count(*) FILTER (p <= 0) AS zero_tokens"


def _report(scored: DataFrame) -> DataFrame:
    return _shown(L.perplexity(scored))


def _shown(p: DataFrame, *more: str) -> DataFrame:
    return p.select(*more, F.when(F.col("perplexity") == float("inf"), 1e300).otherwise(F.round("perplexity", 4)).alias("perplexity"), "tokens", "zero_tokens")


@query(f"WITH {_TOP2}, x AS (SELECT coalesce(c.c / n.total, 0.0) AS p FROM q LEFT JOIN c USING (ctx, w) LEFT JOIN n USING (ctx)) SELECT {_PP} FROM x")
def lm_perplexity_mle(spark, sf_dir):
    """L4, L9; an infinite value is shown as 1e300."""
    return _report(L.score(*_mapped(spark, sf_dir), 2, "mle"))


@query(f"WITH {_TOP2}, x AS (SELECT (coalesce(c.c, 0) + 1) / (coalesce(n.total, 0) + v) AS p FROM q LEFT JOIN c USING (ctx, w) LEFT JOIN n USING (ctx), v) SELECT {_PP} FROM x")
def lm_perplexity_laplace(spark, sf_dir):
    """L5, L9."""
    return _report(L.score(*_mapped(spark, sf_dir), 2, "laplace"))


def _kn(d: str) -> str:
    return f"cc AS (SELECT w, count(*) AS c FROM c GROUP BY 1), cn AS (SELECT sum(c) AS total, count(*) AS types FROM cc), x AS (SELECT CASE WHEN n.total IS NULL THEN p1 ELSE greatest(coalesce(c.c, 0) - {d}, 0) / n.total + {d} * n.types / n.total * p1 END AS p FROM (SELECT q.*, greatest(coalesce(cc.c, 0) - {d}, 0) / cn.total + {d} * cn.types / cn.total / v AS p1 FROM q LEFT JOIN cc USING (w), cn, v) q LEFT JOIN c USING (ctx, w) LEFT JOIN n USING (ctx))"


@query(f"WITH {_TOP2}, {_kn('0.75')} SELECT {_PP} FROM x")
def lm_perplexity_kneser_ney(spark, sf_dir):
    """L6, L7, L9."""
    return _shown(L.smoothed_perplexity(*_mapped(spark, sf_dir), 2, [0.75]))


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_TOP2}, {_kn(d)} SELECT CAST({d} AS DOUBLE) AS discount, {_PP} FROM x)" for d in ("0.3", "0.5", "0.75", "0.9", "1.0")))
def lm_discounts(spark, sf_dir):
    """Perplexity under five discounts."""
    return _shown(L.smoothed_perplexity(*_mapped(spark, sf_dir), 2, [0.3, 0.5, 0.75, 0.9, 1.0]), "discount")


def _level(c: str, n: str, p: str) -> str:
    return f"CASE WHEN {n}.total IS NULL THEN {p} ELSE greatest(coalesce({c}.c, 0) - 0.75, 0) / {n}.total + 0.75 * {n}.types / {n}.total * {p} END AS p"


_TRI = f"""{_VOC}, {_ctx('u', 'tr', 3, 1)}, {_ctx('m2', 'tr', 3, 2)}, {_ctx('m3', 'tr', 3, 3)}, {_ctx('q', 'te', 3, 3)}, v AS (SELECT count(DISTINCT w) AS v FROM u),
c3 AS (SELECT ctx, w, count(*) AS c FROM m3 GROUP BY 1, 2), n3 AS (SELECT ctx, sum(c) AS total, count(*) AS types FROM c3 GROUP BY 1),
c2 AS (SELECT substr(ctx, instr(ctx, ' ') + 1) AS back, w, count(*) AS c FROM c3 GROUP BY 1, 2), n2 AS (SELECT back, sum(c) AS total, count(*) AS types FROM c2 GROUP BY 1),
c1 AS (SELECT w, count(*) AS c FROM (SELECT DISTINCT ctx, w FROM m2) GROUP BY 1), n1 AS (SELECT sum(c) AS total, count(*) AS types FROM c1),
a AS (SELECT q.ctx, q.w, substr(q.ctx, instr(q.ctx, ' ') + 1) AS back, greatest(coalesce(c1.c, 0) - 0.75, 0) / n1.total + 0.75 * n1.types / n1.total / v.v AS p FROM q LEFT JOIN c1 ON c1.w = q.w CROSS JOIN n1 CROSS JOIN v),
b AS (SELECT a.ctx, a.w, {_level('c2', 'n2', 'a.p')} FROM a LEFT JOIN c2 ON c2.back = a.back AND c2.w = a.w LEFT JOIN n2 ON n2.back = a.back),
x AS (SELECT {_level('c3', 'n3', 'b.p')} FROM b LEFT JOIN c3 ON c3.ctx = b.ctx AND c3.w = b.w LEFT JOIN n3 ON n3.ctx = b.ctx)"""


@query(f"WITH {_TRI} SELECT {_PP} FROM x")
def lm_trigram_kneser_ney(spark, sf_dir):
    """L7 of order three."""
    return _shown(L.smoothed_perplexity(*_mapped(spark, sf_dir), 3, [0.75]))


@query(f"WITH {_SENT}, {_ctx('m', 'tr0', 2, 2)}, c AS (SELECT w, pow(count(*), 2.0) AS x FROM (SELECT w FROM m WHERE ctx = 'the') GROUP BY 1 ORDER BY count(*) DESC, w LIMIT 5) SELECT w, round(x / (SELECT sum(x) FROM c), 6) AS p FROM c")
def lm_next_words(spark, sf_dir):
    """The five likeliest words after "the" at temperature 0.5."""
    return L.next_words(_sentences(spark, sf_dir)[0], "the", 2, 0.5, 5).withColumn("p", F.round("p", 6))


@query()
def lm_generate(spark, sf_dir):
    """Twenty texts of at most twenty words from the bigram model."""
    return L.generate(_sentences(spark, sf_dir)[0], 2, 20, 20, seed=7)


@query()
def lm_generate_original(spark, sf_dir):
    """Twenty texts from the trigram model without long copied runs, rendered."""
    found = L.generate_original(_sentences(spark, sf_dir)[0], 3, 20, 20, tries=5, seed=7)
    return found.select("text", "tries", F.size("t").alias("words"), rendered(F.col("t")).alias("line"))


@query()
def lm_generate_characters(spark, sf_dir):
    """Twenty texts of at most thirty characters from the model of five characters."""
    train = _sentences(spark, sf_dir)[0].select("sid", F.transform(characters(F.array_join("t", " ")), lambda c: F.when(c == " ", "_").otherwise(c)).alias("t"))
    found = L.generate_original(train, 5, 20, 30, share=0.9, most=20, tries=2, seed=7, least=3)
    return found.select("text", "tries", F.replace(F.array_join("t", ""), F.lit("_"), F.lit(" ")).alias("line"))


_GRAM = "SELECT unnest(list_transform(range(1, len(t) - {m}), lambda i: array_to_string(t[i:i + {k}], ' '))) AS g FROM {src} WHERE len(t) >= {n}"


def _bench_units() -> str:
    return f"b AS (SELECT item_id AS sid, {_CLEAN} AS t FROM benchmark), d AS (SELECT doc_id AS sid, {_CLEAN} AS t FROM documents)"


@query(f"WITH {_bench_units()}, g AS ({_GRAM.format(m=3, k=4, n=5, src='b')}), h AS (SELECT DISTINCT g FROM ({_GRAM.format(m=3, k=4, n=5, src='d')})) SELECT count(*) AS total, round(count(h.g) / count(*), 6) AS ratio FROM g LEFT JOIN h USING (g)")
def copied_ngrams(spark, sf_dir):
    """5-grams of the benchmark that documents have."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sid"), words(F.col("text")).alias("t"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), words(F.col("text")).alias("t"))
    return L.copied(b, d, 5).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_bench_units()} SELECT CAST(max(CASE WHEN c > 0 THEN n ELSE 0 END) AS INTEGER) AS longest FROM (" + " UNION ALL ".join(f"SELECT {n} AS n, count(*) AS c FROM ({_GRAM.format(m=n - 2, k=n - 1, n=n, src='b')}) a WHERE g IN ({_GRAM.format(m=n - 2, k=n - 1, n=n, src='d')})" for n in (1, 6, 12)) + ")")
def longest_copied_span(spark, sf_dir):
    """The longest run, at most 12 words, of a benchmark item in a document."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sid"), words(F.col("text")).alias("t"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), words(F.col("text")).alias("t"))
    return L.longest_copied(b, d)


@query(f"WITH {_SENT} SELECT round((SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM tr0)) / sum(len(t)), 6) AS unique_ratio, round(avg(len(t)), 6) AS mean_length FROM tr0")
def unit_shape(spark, sf_dir):
    """L17."""
    train = _sentences(spark, sf_dir)[0]
    u = train.select(F.explode("t").alias("w")).agg(F.countDistinct("w").alias("u"))
    return train.agg(F.sum(F.size("t")).alias("n"), F.round(F.avg(F.size("t")), 6).alias("mean_length")).join(u).select(F.round(F.col("u") / F.col("n"), 6).alias("unique_ratio"), "mean_length")
