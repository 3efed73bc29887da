"""Queries of tokens, n-grams, string measures, stems and subword units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as S, stemming, text as X, treebank as B
from ..operators import sentences as N, subwords as U, table_functions as TF, tokens as T
from ..sources.stored import kept, written
from ._register import query, table

_STOP = "(" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_CLEAN = r"trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')), '\s+', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '')"
_LM = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[''’\-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]')"


def _grams(n: int, cond: str = "true") -> str:
    w = ", ".join(f"w[i + {k}]" for k in range(n))
    return f"""t AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: [{w}])) AS g FROM t WHERE len(w) >= {n}),
c AS (SELECT array_to_string(g, ' ') AS gram, count(*) AS c FROM g WHERE {cond} GROUP BY 1)"""


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _words(c: str = "text") -> Column:
    return X.words(F.col(c))


@query(f"SELECT doc_id, len({_WORDS}) AS n_words, length(text) AS chars, strlen(text) AS bytes, len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')) AS pieces FROM documents")
def text_lengths(spark, sf_dir):
    """Words, characters, bytes and white-space pieces."""
    return _docs(spark, sf_dir).select("doc_id", F.size(_words()).cast("long").alias("n_words"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), " ")).cast("long").alias("pieces"))


@query("SELECT DISTINCT c, ord(c) AS code, upper(hex(encode(c))) AS utf8 FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def code_points(spark, sf_dir):
    """Every character that occurs, its code point and its UTF-8 bytes."""
    return _docs(spark, sf_dir).select(F.explode(X.characters(F.col("text"))).alias("c")).distinct().select("c", F.ascii("c").cast("long").alias("code"), F.hex(F.encode("c", "UTF-8")).alias("utf8"))


@query("SELECT doc_id, translate(lower(text), 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ') AS folded FROM documents WHERE doc_id % 100 >= 0")
def fold_letters(spark, sf_dir):
    """X9, X10."""
    return _docs(spark, sf_dir).select("doc_id", X.fold_polish(F.lower("text")).alias("folded"))


@query()
def unicode_forms(spark, sf_dir):
    """Lengths of the composed and decomposed forms, and whether they are equal."""
    @F.pandas_udf("composed long, decomposed long, equal boolean")
    def forms(text: pd.Series) -> pd.DataFrame:
        c, d = text.str.normalize("NFC"), text.str.normalize("NFD")
        return pd.DataFrame({"composed": c.str.len(), "decomposed": d.str.len(), "equal": c == d})

    return _docs(spark, sf_dir).select("doc_id", forms(F.coalesce("text", F.lit(""))).alias("f")).select("doc_id", "f.*")


@query(f"WITH {_grams(2)} SELECT gram, c FROM c ORDER BY c DESC, gram LIMIT 50")
def top_bigrams(spark, sf_dir):
    """The 50 most frequent; the limit is the report's."""
    return T.top_grams(T.gram_counts(_docs(spark, sf_dir), _words(), 2), 50)


@query(f"WITH {_grams(1)} SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS uniques, round(count(*) FILTER (c = 1) / count(*), 6) AS hapax_share, round((SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC LIMIT 10)) / sum(c), 6) AS top10_share, max(c) AS largest FROM c")
def word_distribution(spark, sf_dir):
    """A23."""
    return T.distribution(T.gram_counts(_docs(spark, sf_dir), _words(), 1)).withColumns({c: F.round(c, 6) for c in ("hapax_share", "top10_share")})


@query(f"WITH {_grams(1)} SELECT gram, c, row_number() OVER (ORDER BY c DESC, substr(gram, 1, 2), gram) AS rank FROM c")
def zipf_ranks(spark, sf_dir):
    """A24, O9."""
    return T.rank_frequency(T.gram_counts(_docs(spark, sf_dir), _words(), 1))


@query(f"WITH {_grams(2, f'len(list_filter(g, lambda w: w IN {_STOP})) = 0')} SELECT gram, c FROM c")
def content_bigrams(spark, sf_dir):
    """No stop word at all."""
    return T.content_grams(_docs(spark, sf_dir), _words(), 2)


@query(f"WITH {_grams(3, f'len(list_filter(g, lambda w: w IN {_STOP})) < 3')} SELECT gram, c FROM c")
def content_trigrams(spark, sf_dir):
    """Not only stop words."""
    return T.content_grams(_docs(spark, sf_dir), _words(), 3, drop_if="all")


@query(f"WITH t AS (SELECT lang, {_WORDS} AS w FROM documents) SELECT lang, CAST(sum(len(w)) AS BIGINT) AS before, CAST(sum(len(list_filter(w, lambda x: x NOT IN {_STOP}))) AS BIGINT) AS after, round(1 - sum(len(list_filter(w, lambda x: x NOT IN {_STOP}))) / sum(len(w)), 6) AS removed FROM t GROUP BY 1")
def stop_word_share(spark, sf_dir):
    """X15, X16, U4."""
    t = _docs(spark, sf_dir).select("lang", _words().alias("w"))
    t = t.select("lang", F.size("w").alias("a"), F.size(F.filter("w", lambda x: ~x.isin(*X.STOP_WORDS))).alias("b"))
    return t.groupBy("lang").agg(F.sum("a").alias("before"), F.sum("b").alias("after")).withColumn("removed", F.round(1 - F.col("after") / F.col("before"), 6))


@query("WITH g AS (SELECT lang, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS g FROM (SELECT lang, string_split(lower(text), '') AS t FROM documents) WHERE len(t) >= 3), c AS (SELECT lang, g, count(*) AS c FROM g GROUP BY 1, 2) SELECT lang, g, c FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) r FROM c) WHERE r <= 20")
def language_fingerprint(spark, sf_dir):
    """The 20 commonest letter trigrams of each language."""
    from ..operators.ranking import top_per_group

    chars = _docs(spark, sf_dir).select("lang", X.characters(F.lower("text")).alias("chars"))
    c = T.each(chars, X.char_ngrams(F.col("chars"), 3), "g", "lang").groupBy("lang", "g").agg(F.count("*").alias("c"))
    return top_per_group(c, "lang", [F.desc("c"), F.col("g")], 20).drop("rank")


@query(f"WITH t AS (SELECT {_WORDS} AS w FROM documents), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS g FROM t WHERE len(w) >= 2), c AS (SELECT g[1] AS w, g[2] AS next, count(*) AS c FROM p GROUP BY 1, 2) SELECT w, next, c FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY c DESC, next) r, sum(c) OVER (PARTITION BY w) s FROM c) WHERE r = 1 AND s >= 50")
def likely_successors(spark, sf_dir):
    """The most frequent next word of words that occur 50 times or more."""
    c = T.successors(_docs(spark, sf_dir), _words()).groupBy("w", "next").agg(F.count("*").alias("c"))
    return c.groupBy("w").agg(F.sum("c").alias("s"), F.min_by(F.struct("next", "c"), F.struct(-F.col("c"), F.col("next"))).alias("b")).where("s >= 50").select("w", "b.next", "b.c")


@query(f"SELECT doc_id, len({_LM}) AS tokens, array_to_string(list_slice({_LM}, 1, 5), ' ') AS head FROM documents")
def lm_tokenise(spark, sf_dir):
    """X43, X48."""
    t = _docs(spark, sf_dir).select("doc_id", X.lm_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.!?]\\s+[^\\s]')) + 1 AS sentences FROM documents WHERE trim(text) <> ''")
def count_sentences(spark, sf_dir):
    """X7."""
    return _docs(spark, sf_dir).where(F.trim("text") != "").select("doc_id", (F.size(F.regexp_extract_all("text", F.lit(r"([.!?]\s+\S)"))) + 1).cast("long").alias("sentences"))


_CLOSE = r"""["'')\]}»”’]*\z"""
_TYPE = r"(CASE WHEN regexp_matches({0}, '^\p{{N}}[\p{{N}}.,]*\z') THEN '##number##' ELSE lower({0}) END)"
_FACTS = rf"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v{chr(160)}]+'), lambda w: w <> '') AS t FROM documents),
x AS (SELECT doc_id, unnest(t) AS a, unnest(list_append(list_slice(t, 2, len(t)), NULL)) AS b, generate_subscripts(t, 1) - 1 AS pos FROM t),
y AS (SELECT doc_id, pos, CASE WHEN regexp_matches(a, '[!?]{_CLOSE}') THEN 'hard' WHEN regexp_matches(a, '\.{_CLOSE}') THEN 'dot' END AS k, regexp_replace(a, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+\z', '', 'g') AS pa, regexp_replace(b, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+\z', '', 'g') AS pb FROM x),
z AS MATERIALIZED (SELECT doc_id, pos, k, {_TYPE.format("pa")} AS w, regexp_matches(pa, '^\p{{Lu}}') AS up, {_TYPE.format("pb")} AS nxt, regexp_matches(pb, '^\p{{Lu}}') AS nup FROM y),
begun AS (SELECT w, count(*) AS n FROM (SELECT nxt AS w FROM z WHERE k IS NOT NULL AND nup UNION ALL SELECT w FROM z WHERE pos = 0 AND up) GROUP BY 1),
ty AS MATERIALIZED (SELECT w, count(*) AS c, count(*) FILTER (k = 'dot') AS dots, count(*) FILTER (NOT up) AS lower, count(*) FILTER (up) - coalesce(any_value(n), 0) AS inside FROM z LEFT JOIN begun USING (w) WHERE w <> '' GROUP BY 1),
s AS (SELECT sum(c) AS n, sum(dots) AS periods FROM ty),
ab AS MATERIALIZED (SELECT w, c, dots, -2 * ((CASE WHEN periods = n THEN 0 ELSE dots * ln(periods / n) + (c - dots) * ln(1 - periods / n) END) - (dots * ln(0.99) + (c - dots) * ln(0.01))) * exp(-length(replace(w, '.', ''))) * (length(w) - length(replace(w, '.', '')) + 1) * pow(length(replace(w, '.', '')), -(c - dots)) AS score
  FROM ty, s WHERE dots > 0 AND w <> '##number##' AND regexp_matches(w, '\p{{L}}'))"""


@query(f"WITH {_FACTS} SELECT w, c, dots, round(score, 6) + 0.0 AS score FROM ab")
def abbreviation_scores(spark, sf_dir):
    """How surely each word type that ever has a period after it is an abbreviation."""
    return N.abbreviations(N.types(written(N.facts(_docs(spark, sf_dir))))).withColumn("score", F.round("score", 6) + F.lit(0.0))


def _ratio(a: str, b: str, both: str, n: str) -> str:
    part = lambda hits, n, p: f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE ({hits}) * ln({p}) + (({n}) - ({hits})) * ln(1 - {p}) END)"
    p, p1, p2 = f"({b} / {n})", f"({both} / {a})", f"(({b} - {both}) / ({n} - {a}))"
    return f"-2 * ({part(both, a, p)} + {part(f'{b} - {both}', f'{n} - {a}', p)} - {part(both, a, p1)} - {part(f'{b} - {both}', f'{n} - {a}', p2)})"


_LEARNED = rf"""{_FACTS}, pr AS MATERIALIZED (SELECT doc_id, pos, k, z.w, nxt, nup, coalesce(ab.score >= 0.3, false) AS short, regexp_matches(z.w, '^\p{{L}}\z') AS initial, z.w = '##number##' AS number FROM z LEFT JOIN ab USING (w) WHERE k IS NOT NULL AND nxt <> ''),
e AS (SELECT nxt AS w, count(*) AS begun FROM pr WHERE k = 'hard' OR NOT (short OR initial OR number) GROUP BY 1), en AS (SELECT sum(begun) AS ends FROM e),
st AS (SELECT w, score FROM (SELECT w, {_ratio('ends', 'c', 'begun', 'n')} AS score FROM e JOIN ty USING (w), en, s WHERE begun * n > c * ends AND ends < n) WHERE score >= 30),
co AS (SELECT w, nxt FROM (SELECT p.w, p.nxt, {_ratio('a.c', 'b.c', 'times', 'n')} AS score FROM (SELECT w, nxt, count(*) AS times FROM pr WHERE k = 'dot' AND (initial OR number) GROUP BY 1, 2) p JOIN ty a ON a.w = p.w JOIN ty b ON b.w = p.nxt, s
  WHERE times > 1 AND p.nxt NOT IN (SELECT w FROM st) AND times * n > a.c * b.c AND a.c < n) WHERE score >= 7.88),
de AS (SELECT doc_id, pos, CASE WHEN k = 'hard' OR NOT (short OR initial OR number) THEN true WHEN short AND NOT initial THEN fin ELSE NOT (habit OR NOT nup OR (initial AND nup AND low = 0 AND NOT fin)) END AS ends
  FROM (SELECT pr.*, coalesce(ty.lower, 0) AS low, nup AND ((coalesce(ty.lower, 0) > 0 AND ty.inside = 0) OR st.w IS NOT NULL) AS fin, co.w IS NOT NULL AS habit FROM pr LEFT JOIN ty ON ty.w = pr.nxt LEFT JOIN st ON st.w = pr.nxt LEFT JOIN co ON co.w = pr.w AND co.nxt = pr.nxt)
  UNION ALL SELECT doc_id, pos, true FROM z WHERE k IS NOT NULL AND nxt = '')"""


@query(f"WITH {_LEARNED} SELECT w, round(score, 6) AS score FROM st")
def sentence_starters(spark, sf_dir):
    """Word types that stand at the beginning of sentences more often than by chance."""
    kinds = written(N.types(counts := written(N.facts(_docs(spark, sf_dir)))))
    return N.starters(kinds, N._pairs(counts, N.abbreviations(kinds))).withColumn("score", F.round("score", 6))


@query(f"WITH {_LEARNED} SELECT doc_id, count(*) + 1 AS sentences, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS ends FROM de WHERE ends GROUP BY 1")
def learned_sentences(spark, sf_dir):
    """Sentences of the documents that have more than one, and their last words' places."""
    docs = _docs(spark, sf_dir)
    found = N.ends(docs, N.learn(docs)).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    return found.select("doc_id", (F.size("p") + 1).cast("long").alias("sentences"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("ends"))


def _rules_sql(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        by = re.sub(r"\$(\d)", r"\\\1", by)
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"
    return c


_TREEBANK = rf"""k AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, list_filter(regexp_split_to_array({_rules_sql('s', B.RULES)}, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS t FROM k)"""


@query(f"WITH {_TREEBANK} SELECT doc_id, CAST(sum(len(t)) AS BIGINT) AS tokens, md5(string_agg(array_to_string(t, ' '), ' ' ORDER BY i) FILTER (len(t) > 0)) AS digest FROM w GROUP BY 1")
def treebank_tokens(spark, sf_dir):
    """The tokens of each document, and a digest of them."""
    t = _docs(spark, sf_dir).select("doc_id", B.text_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.when(F.size("t") > 0, F.md5(F.array_join("t", " "))).alias("digest"))


@query(f"WITH {_TREEBANK} SELECT sentence, tokens FROM (SELECT trim({_rules_sql("' ' || array_to_string(t, ' ') || ' '", B.INVERSE)}) AS sentence, count(*) AS tokens FROM w WHERE len(t) > 0 GROUP BY 1)")
def rejoined_sentences(spark, sf_dir):
    """Sentences that are joined from their tokens again, and how often each stands."""
    parts = T.each(_docs(spark, sf_dir), F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])[ \t\n\r\f\x0B]+", "$1\u0001"), "\u0001"), "s")
    # the size is tested on the sums: a test of each row would apply all rules once more
    t = parts.select(B.tokens(F.col("s")).alias("t")).select(B.joined(F.col("t")).alias("sentence"), F.size("t").alias("n"))
    return t.groupBy("sentence").agg(F.count("*").alias("tokens"), F.max("n").alias("n")).where("n > 0").select("sentence", "tokens")


_CLOSE_BEFORE, _CLOSE_AFTER = ("(" + ",".join(f"'{c}'" for c in signs) + ")" for signs in (B.CLOSE_BEFORE, B.CLOSE_AFTER))


_LM_OF_PART = _LM.replace("lower(text)", "lower(p)")


@query(f"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda p: {_LM_OF_PART}), lambda t: len(t) > 0) AS u FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, array_to_string(list_transform(u, lambda t: list_reduce(t, lambda o, x: CASE WHEN x IN {_CLOSE_BEFORE} OR right(o, 1) IN {_CLOSE_AFTER} THEN o || x ELSE o || ' ' || x END)), chr(10)) AS text FROM l WHERE len(u) > 0""")
def rendered_units(spark, sf_dir):
    """The tokens of each turn, an end mark after each sentence, split by it and rendered."""
    parts = F.split(F.regexp_replace("text", r"([.!?])[ \t\n\r\f\x0B]+", "$1\u0001"), "\u0001")
    stream = F.flatten(F.transform(parts, lambda p: F.concat(X.lm_tokens(p), F.array(F.lit("</s>")))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", B.rendered_units(stream, "</s>").alias("text")).where("text <> ''")


_SENT_STOP = "(" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_NEG = "(" + ",".join(f"'{w}'" for w in X.NEGATIONS) + ")"


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), 'n''t|[a-z]+(?:''[a-z]+)*') AS t FROM documents), k AS (SELECT doc_id, t, list_filter(t, lambda w: w NOT IN {_SENT_STOP} OR w IN {_NEG} OR ends_with(w, 'n''t')) AS k FROM t) SELECT doc_id, len(t) AS before, len(CASE WHEN len(k) > 0 THEN k ELSE t END) AS after, len(list_filter(t, lambda w: w IN {_NEG} OR ends_with(w, 'n''t'))) > 0 AS negated FROM k")
def sentiment_preprocess(spark, sf_dir):
    """A32, X46, M17."""
    t = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"(n't|[a-z]+(?:'[a-z]+)*)"), 1).alias("t"), X.sentiment_tokens(F.col("text")).alias("k"))
    return t.select("doc_id", F.size("t").cast("long").alias("before"), F.size("k").cast("long").alias("after"), F.exists("t", lambda w: w.isin(*X.NEGATIONS) | F.endswith(w, F.lit("n't"))).alias("negated"))


def _name_pairs(spark, sf_dir) -> DataFrame:
    """p_partkey, the part's name (b) and that of the part before it (a)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("b"))
    return part.join(part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("b").alias("a")), "p_partkey")


_NAME_PAIRS = "p AS (SELECT p.p_partkey, q.p_name AS a, p.p_name AS b, string_split(q.p_name, '') AS ca, string_split(p.p_name, '') AS cb FROM part p JOIN part q ON q.p_partkey = p.p_partkey - 1)"


@query(f"""WITH {_NAME_PAIRS}, m AS (SELECT *, greatest(length(a), length(b)) AS n, list_sum(list_transform(list_distinct(ca), lambda x: least(len(list_filter(ca, lambda y: y = x)), len(list_filter(cb, lambda y: y = x))))) AS inter FROM p),
r AS (SELECT p_partkey, levenshtein(a, b) AS lev, damerau_levenshtein(a, b) AS dam, round(1 - jaro_winkler_similarity(a, b), 6) AS jw, round(1 - inter / (length(a) + length(b) - inter), 6) AS jac, 1 - levenshtein(a, b) / n AS nl, 1 - damerau_levenshtein(a, b) / n AS nd, jaro_winkler_similarity(a, b) AS sj, inter / (length(a) + length(b) - inter) AS sc FROM m)
SELECT p_partkey, lev, dam, jw, jac, round(nl, 6) AS nl, round(greatest(nl, nd, sj, sc) - least(nl, nd, sj, sc), 6) AS spread FROM r""")
def string_measures(spark, sf_dir):
    """Four measures of each part's name and the one before it, and how far they are apart."""
    a, b = F.col("a"), F.col("b")
    n = F.greatest(F.length(a), F.length(b))
    m = _name_pairs(spark, sf_dir).select("p_partkey", "a", "b", F.levenshtein(a, b).alias("lev"), S.damerau_column()(a, b).alias("dam"), S.jaro_winkler_column()(a, b).alias("sj"), X.multiset_jaccard(X.characters(a), X.characters(b)).alias("sc"))
    every = [1 - F.col("lev") / n, 1 - F.col("dam") / n, F.col("sj"), F.col("sc")]
    return m.select("p_partkey", F.col("lev").cast("long").alias("lev"), F.col("dam").cast("long").alias("dam"), F.round(1 - F.col("sj"), 6).alias("jw"), F.round(1 - F.col("sc"), 6).alias("jac"), F.round(every[0], 6).alias("nl"), F.round(F.greatest(*every) - F.least(*every), 6).alias("spread"))


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n) AS lev, round(jaro_winkler_similarity(a.n, b.n), 6) AS jw, round(len(list_intersect(string_split(a.n, ' '), string_split(b.n, ' '))) / sqrt(len(string_split(a.n, ' ')) * len(string_split(b.n, ' '))), 6) AS cos FROM n a JOIN n b ON a.n < b.n AND levenshtein(a.n, b.n) <= 3""")
def name_pairs(spark, sf_dir):
    """Distinct part names within three edits."""
    a, b = F.col("a"), F.col("b")
    pairs = T.near_pairs(table(spark, sf_dir, "part").select("p_name"), "p_name", 3)
    return pairs.select("a", "b", F.col("distance").cast("long").alias("lev"), F.round(S.jaro_winkler_column()(a, b), 6).alias("jw"), F.round(X.bag_cosine(F.split(a, " "), F.split(b, " ")), 6).alias("cos"))


@query(f"""WITH {_NAME_PAIRS}, v AS (SELECT w, chr(CAST(32 + row_number() OVER (ORDER BY w) AS INTEGER)) AS c FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)), vm AS (SELECT map(list(w), list(c)) AS m FROM v)
SELECT p_partkey, levenshtein(a, b) AS edits, length(b) - length(a) AS growth, levenshtein(array_to_string(list_transform(string_split(a, ' '), lambda w: m[w]), ''), array_to_string(list_transform(string_split(b, ' '), lambda w: m[w]), '')) AS word_distance FROM p, vm""")
def edit_scripts(spark, sf_dir):
    """Edits of cheapest scripts between names, and distances of their word lists."""
    a, b = F.col("a"), F.col("b")
    ops = _name_pairs(spark, sf_dir).withColumn("o", S.edit_script_column()(a, b)).withColumn("w", S.word_distance_column()(F.split(a, " "), F.split(b, " ")))
    one = lambda name: F.size(F.filter("o", lambda x: F.startswith(x, F.lit(name + ":"))))
    count = lambda *names: sum(map(one, names), F.lit(0))
    return ops.select("p_partkey", count("insert", "substitute", "delete").cast("long").alias("edits"), (count("insert") - count("delete")).cast("long").alias("growth"), F.col("w").cast("long").alias("word_distance"))


@query("""SELECT p.p_partkey, levenshtein(q.p_name, p.p_name) AS edits, length(p.p_name) - length(q.p_name) AS growth, true AS whole FROM part p JOIN part q ON q.p_partkey = p.p_partkey - 1""")
def name_edit_steps(spark, sf_dir):
    """Steps that turn each part's name into the next one's, by a table function joined laterally."""
    pairs = _name_pairs(spark, sf_dir)
    n = lambda *kinds: F.count_if(F.col("operation").isin(*kinds))
    steps = TF.edit_steps(pairs, "a", "b").groupBy("p_partkey", "a", "b").agg(n("insert", "delete", "substitute").alias("edits"), (n("insert") - n("delete")).alias("growth"), F.count("*").alias("n"))
    return steps.select("p_partkey", "edits", "growth", (F.col("n") >= F.greatest(F.length("a"), F.length("b"))).alias("whole"))


@query("""WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_retailprice >= lag(p_retailprice) OVER w THEN 0 ELSE 1 END AS begins FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
r AS (SELECT p_brand, p_partkey, sum(begins) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS run FROM s) SELECT p_brand AS part, CAST(run AS INTEGER) AS run, min(p_partkey) AS first, max(p_partkey) AS last, count(*) AS rows FROM r GROUP BY 1, 2""")
def rising_prices(spark, sf_dir):
    """Runs of each brand's parts whose prices never fall, by a table function over partitioned input."""
    return TF.rising_runs(table(spark, sf_dir, "part"), F.col("p_brand"), F.col("p_partkey"), F.col("p_retailprice"))


def _vocabulary(spark, sf_dir) -> DataFrame:
    return T.each(_docs(spark, sf_dir), _words(), "w").groupBy("w").agg(F.count("*").alias("c"))


@query()
def stem_table(spark, sf_dir):
    """Words of the documents whose two stems differ."""
    return T.stem_disagreements(stemming.stem_vocabulary(_vocabulary(spark, sf_dir), "w"))


@query()
def lancaster_table(spark, sf_dir):
    """Words of the documents whose Porter and Lancaster stems differ."""
    stems = stemming.stem_vocabulary(_vocabulary(spark, sf_dir), "w", ("porter", "lancaster"))
    return T.stem_disagreements(stems, "porter", "lancaster")


@query()
def over_and_under_stemming(spark, sf_dir):
    """Stems that gather unrelated suffix-stripped forms."""
    stems = stemming.stem_vocabulary(_vocabulary(spark, sf_dir), "w").withColumn("lemma", F.regexp_replace("w", "(s|ed|ing)$", ""))
    over = T.over_stemmed(stems, "porter", "lemma").select(F.lit("over").alias("kind"), F.col("porter").alias("k"), F.size("lemmas").cast("long").alias("n"))
    return over.unionAll(T.under_stemmed(stems, "porter", "lemma").select(F.lit("under"), "lemma", "n"))


@query()
def byte_pair_units(spark, sf_dir):
    """Corpus tokens after 0, 4, 8 and 12 merges of one list."""
    counts = written(_vocabulary(spark, sf_dir).withColumnRenamed("w", "word"))
    merges = T.train_bpe(counts, 12)
    out = None
    for k in (0, 4, 8, 12):
        pieces = T.apply_bpe(counts, "word", merges[:k]).agg(F.sum(F.size("pieces") * F.col("c")).alias("tokens")).select(F.lit(k).alias("merges"), "tokens")
        out = pieces if out is None else out.unionAll(pieces)
    return out


def _byte_pieces(spark, sf_dir) -> DataFrame:
    """The pieces of all documents and how often they stand, counted once for each version of the table."""
    return spark.read.parquet(kept(spark, f"{sf_dir}/documents.parquet", "byte pieces", lambda folder: U.piece_counts(_docs(spark, sf_dir)).write.option("compression", "zstd").parquet(folder)))


def _byte_merges(spark, sf_dir) -> DataFrame:
    """1000 merges over all documents, trained once for each version of the table."""
    def make(folder: str) -> None:
        found = U.train(_byte_pieces(spark, sf_dir), 1000)
        spark.createDataFrame([(k, x, y, n) for k, ((x, y), n) in enumerate(found)], "rank int, first int, second int, c long").coalesce(1).write.parquet(folder)

    return spark.read.parquet(kept(spark, f"{sf_dir}/documents.parquet", "byte merges", make))


def _byte_vocabulary(merges: DataFrame) -> U.ByteVocabulary:
    return U.ByteVocabulary([(r["first"], r["second"]) for r in merges.orderBy("rank").collect()])  # as many as were asked for


@query()
def byte_level_merges(spark, sf_dir):
    """The merges of a byte-level vocabulary with five special tokens."""
    return _byte_merges(spark, sf_dir)


@query()
def byte_level_units(spark, sf_dir):
    """Units of each document, and whether they give the text back."""
    vocabulary = _byte_vocabulary(_byte_merges(spark, sf_dir))
    units = U.encode(_docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), vocabulary)
    back = U.decode(F.col("ids"), vocabulary)
    return units.select("doc_id", F.size("ids").cast("long").alias("units"), ((back == F.col("text")) | (back == F.concat(F.lit(" "), "text"))).alias("lossless"))


@query()
def byte_level_curve(spark, sf_dir):
    """Units of all documents after 0, 250, 500 and 1000 merges."""
    merges = _byte_vocabulary(_byte_merges(spark, sf_dir)).merges
    return U.unit_counts(_byte_pieces(spark, sf_dir), merges, (0, 250, 500, 1000))


@query(f"""WITH t AS (SELECT {_WORDS} AS w FROM documents), v AS (SELECT 'words' AS variant, unnest(w) AS unit FROM t UNION ALL SELECT 'no stop words', unnest(list_filter(w, lambda x: x NOT IN {_STOP})) FROM t),
s AS (SELECT variant, count(*) AS units, count(DISTINCT unit) AS vocabulary FROM v GROUP BY 1), b AS (SELECT vocabulary AS base, units AS words FROM s WHERE variant = 'words') SELECT variant, units, vocabulary, round(vocabulary / units, 6) AS ttr, round(units / words, 6) AS per_word, round((vocabulary / base - 1) * 100, 6) AS change FROM s, b""")
def variant_table(spark, sf_dir):
    """A29, X42."""
    t = _docs(spark, sf_dir).select(_words().alias("w"))
    v = t.select(F.lit("words").alias("variant"), F.explode("w").alias("unit")).unionAll(t.select(F.lit("no stop words"), F.explode(F.filter("w", lambda x: ~x.isin(*X.STOP_WORDS)))))
    return T.variant_stats(v, "words").withColumns({c: F.round(c, 6) for c in ("ttr", "per_word", "change")})


@query()
def four_variants(spark, sf_dir):
    """Words, stems in the place of lemmas, words without stop words, and byte-level units."""
    words = written(_vocabulary(spark, sf_dir).select(F.col("w").alias("unit"), "c"))
    stems = stemming.stem_vocabulary(words, "unit", ("snowball",)).select(F.lit("stems").alias("variant"), F.col("snowball").alias("unit"), "c")
    units = U.piece_units(_byte_pieces(spark, sf_dir), _byte_vocabulary(_byte_merges(spark, sf_dir)))
    every = words.select(F.lit("words").alias("variant"), "unit", "c").unionAll(stems).unionAll(words.where(~F.col("unit").isin(*X.STOP_WORDS)).select(F.lit("no stop words"), "unit", "c"))
    every = every.unionAll(units.select(F.lit("byte units"), F.col("unit").cast("string"), "c"))
    return T.variant_counts(every, "words").withColumns({c: F.round(c, 6) for c in ("ttr", "per_word", "change")})


@query(f"SELECT lang, round(avg(len({_WORDS})), 6) AS words, round(avg(length(text)), 6) AS chars, round(avg(len({_LM})), 6) AS lm FROM documents GROUP BY 1")
def language_tax(spark, sf_dir):
    """Mean units of each language under three tokenisers."""
    t = _docs(spark, sf_dir).select("lang", F.size(_words()).alias("a"), F.length("text").alias("b"), F.size(X.lm_tokens(F.col("text"))).alias("c"))
    return t.groupBy("lang").agg(F.round(F.avg("a"), 6).alias("words"), F.round(F.avg("b"), 6).alias("chars"), F.round(F.avg("c"), 6).alias("lm"))


@query("""WITH s AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
b AS (SELECT DISTINCT trim(p) AS phrase FROM (SELECT unnest(string_split(regexp_replace(l, '([.!?])[ \\t\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))) AS p FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark)) WHERE trim(p) <> '')
SELECT phrase, arg_min(line, (doc_id, pos)) AS sentence FROM s JOIN b ON contains(line, phrase) GROUP BY 1""")
def first_line_with_phrase(spark, sf_dir):
    """The first line that holds each whole sentence of the benchmark's items."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "sentence"))
    phrases = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("l")).select(F.explode(X.sentences(F.col("l"))).alias("phrase")).distinct()
    return T.first_sentence_with(lines, phrases)


@query("""WITH l AS (SELECT conv_id AS song, turn AS pos, trim(text) AS line FROM conversations WHERE role = 'user' AND trim(text) <> ''),
o AS (SELECT song, pos, line, row_number() OVER (PARTITION BY song ORDER BY pos) AS k FROM (SELECT *, row_number() OVER (PARTITION BY song, lower(line) ORDER BY pos) AS r FROM l) WHERE r = 1),
f AS (SELECT min(song) AS song FROM (SELECT song, lower(string_agg(line, ' ' ORDER BY pos)) AS print FROM o WHERE k <= 4 GROUP BY 1) GROUP BY print),
u AS (SELECT o.*, row_number() OVER (PARTITION BY lower(line) ORDER BY o.song, pos) AS r FROM o JOIN f ON f.song = o.song) SELECT song, line FROM u WHERE r = 1""")
def song_cleaning(spark, sf_dir):
    """Conversations as songs, a header before each turn that names who sings it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song"), "turn", "role", "text")
    header = F.when(F.col("role") == "user", F.lit("[Zwrotka: Ala]")).otherwise(F.lit("[Refren: Gość]"))
    lines = turns.select("song", F.posexplode(F.array(header, F.coalesce("text", F.lit("")))).alias("k", "line"), "turn").select("song", (2 * F.col("turn") + F.col("k")).alias("pos"), "line")
    return T.distinct_songs(T.song_lines(lines, "Ala")).select("song", "line")


@query(r"SELECT doc_id, length(body) AS chars, md5(body) AS digest FROM (SELECT doc_id, trim(regexp_replace(ltrim(text), '[ \t\n\r\f\v]+\z', '')) AS body FROM documents WHERE text IS NOT NULL)")
def book_frame(spark, sf_dir):
    """What stands between a book's header and footer, put around each document."""
    book = F.concat(F.lit("Nagłówek\n*** START OF THE BOOK ***\n"), "text", F.lit("\n*** END OF THE BOOK ***\nlicencja"))
    body = F.trim(F.regexp_replace(X.book_body(book, "*** START OF", "*** END OF"), r"[ \t\n\r\f\x0B]+\z", ""))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", body.alias("b")).select("doc_id", F.length("b").cast("long").alias("chars"), F.md5("b").alias("digest"))


@query()
def proper_names(spark, sf_dir):
    """Capitalised words that follow a word, comma, semicolon or colon."""
    found = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"((?<=[\p{L}\p{N}_,;:] )\p{Lu}\p{Ll}+)"), 1)).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("c"))
