"""Queries of full-text search over documents: the first line is the title."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import STOP_WORDS
from ..operators import search as S
from ..sources.stored import written
from ._register import query, table

_STOP = "(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"
_INDEX = rf"""d AS (SELECT doc_id, lang, source, n_chars, string_split(text, chr(10))[1] AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM documents),
w AS (SELECT doc_id, field, list_filter(list_zip(t, range(0, len(t))), lambda x: x[1] NOT IN {_STOP}) AS x FROM (SELECT doc_id, 'title' AS field, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS t FROM d UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') FROM d)),
i AS (SELECT u[1] AS term, doc_id, field, CAST(u[2] AS INTEGER) AS pos FROM (SELECT doc_id, field, unnest(x) AS u FROM w))"""
_BOOL = S.And((S.Term("er"), S.Or((S.Term("nt"), S.Term("th"))), S.Not(S.Term("onnd"))))


def _docs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.instr("text", "\n")
    body = F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).otherwise("")
    return docs.select("doc_id", "lang", "source", "n_chars", F.split("text", "\n")[0].alias("title"), body.alias("body"), "text")


def _index(spark, sf_dir) -> S.Index:
    return S.stored(_docs(spark, sf_dir), f"{sf_dir}/documents.parquet", ("title", "body"), "documents")


@query(f"WITH {_INDEX} SELECT term, field, count(*) AS places, count(DISTINCT doc_id) AS docs FROM i GROUP BY 1, 2")
def inverted_index(spark, sf_dir):
    """Terms of each field, their places and documents."""
    return S.postings(_docs(spark, sf_dir), ("title", "body")).groupBy("term", "field").agg(F.count("*").alias("places"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH {_INDEX} SELECT DISTINCT doc_id FROM i WHERE term = 'er'")
def term_query(spark, sf_dir):
    """A1, R3."""
    return S.search(_index(spark, sf_dir), S.Term("er"))


@query(f"WITH {_INDEX} SELECT DISTINCT a.doc_id FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'er' AND b.term = 'th'")
def phrase_query(spark, sf_dir):
    """R4."""
    return S.search(_index(spark, sf_dir), S.Phrase(("er", "th")))


@query(f"WITH {_INDEX}, f AS (SELECT doc_id, bool_or(term = 'er') a, bool_or(term = 'nt') b, bool_or(term = 'th') c, bool_or(term = 'onnd') x FROM i GROUP BY 1) SELECT doc_id FROM f WHERE a AND (b OR c) AND NOT x")
def boolean_query(spark, sf_dir):
    """R5."""
    return S.search(_index(spark, sf_dir), _BOOL)


@query("SELECT doc_id FROM documents WHERE contains(text, 'er') AND (contains(text, 'nt') OR contains(text, 'th')) AND NOT contains(text, 'onnd')")
def like_scan(spark, sf_dir):
    """P28, R13."""
    return table(spark, sf_dir, "documents").where(S.like(F.col("text"), _BOOL)).select("doc_id")


@query(f"WITH {_INDEX} SELECT doc_id, round(sum(CASE field WHEN 'title' THEN 1.0 ELSE 0.4 END), 6) AS score FROM i WHERE term = 'er' GROUP BY 1")
def cover_density_rank(spark, sf_dir):
    """R6 for one term."""
    return S.cover_density(_index(spark, sf_dir), ("er",), {"title": 1.0, "body": 0.4}).withColumn("score", F.round("score", 6))


_COVERS = """h AS (SELECT doc_id, field, term, pos FROM i WHERE term IN ('er', 'th')),
e AS (SELECT doc_id, field, pos, max(CASE WHEN term = 'er' THEN pos END) OVER u AS a, max(CASE WHEN term = 'th' THEN pos END) OVER u AS b FROM h WINDOW u AS (PARTITION BY doc_id, field ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT doc_id, field, least(a, b) AS s, min(pos) AS e FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"WITH {_INDEX}, {_COVERS} SELECT doc_id, round(sum(CASE field WHEN 'title' THEN 1.0 ELSE 0.4 END / (1.0 + greatest(e - s - 1, 0))), 6) AS score FROM c GROUP BY 1")
def cover_density_of_two_terms(spark, sf_dir):
    """Covers of both terms."""
    return S.cover_density(_index(spark, sf_dir), ("er", "th"), {"title": 1.0, "body": 0.4}).withColumn("score", F.round("score", 6))


_BM25 = f"""{_INDEX}, l AS (SELECT field, doc_id, count(*) AS dl FROM i GROUP BY 1, 2), s AS (SELECT field, avg(dl) AS avgdl, count(*) AS docs FROM l GROUP BY 1),
t AS (SELECT term, field, doc_id, count(*) AS tf FROM i WHERE term IN ('er', 'th', 'onnd') GROUP BY 1, 2, 3), n AS (SELECT term, field, count(*) AS df FROM t GROUP BY 1, 2),
x AS (SELECT doc_id, term, max(CASE field WHEN 'title' THEN 3.0 ELSE 1.0 END * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM t JOIN n USING (term, field) JOIN s USING (field) JOIN l USING (field, doc_id) GROUP BY 1, 2),
r AS (SELECT doc_id, sum(s) AS score FROM x GROUP BY 1)"""
_TERMS = ["er", "th", "onnd"]


def _ranked(spark, sf_dir) -> DataFrame:
    return S.bm25(_index(spark, sf_dir), _TERMS, {"title": 3.0, "body": 1.0})


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM r")
def bm25_scores(spark, sf_dir):
    """R7."""
    return _ranked(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT doc_id, score FROM (SELECT doc_id, round(score, 6) AS score FROM r) ORDER BY score DESC, doc_id LIMIT 10")
def bm25_top10(spark, sf_dir):
    """The ten best documents."""
    return S.top(_ranked(spark, sf_dir).withColumn("score", F.round("score", 6)))


@query(f"WITH {_BM25}, b AS (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) k FROM (SELECT d.source, doc_id, round(score, 6) AS score FROM r JOIN d USING (doc_id))) SELECT source, doc_id, score FROM b WHERE k = 1 ORDER BY score DESC, doc_id LIMIT 10")
def collapsed_top10(spark, sf_dir):
    """The best document of each source, then the ten best."""
    scored = _ranked(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").select("source", "doc_id", F.round("score", 6).alias("score"))
    return S.collapsed_top(scored, "source")


@query(f"WITH {_BM25}, a AS (SELECT doc_id FROM (SELECT doc_id, round(score, 6) AS s FROM r ORDER BY s DESC, doc_id LIMIT 10)), b AS (SELECT doc_id FROM (SELECT doc_id, round(sum(CASE field WHEN 'title' THEN 1.0 ELSE 0.4 END), 6) AS s FROM i WHERE term = 'er' GROUP BY 1 ORDER BY s DESC, doc_id LIMIT 10)) SELECT count(*) AS shared FROM a JOIN b USING (doc_id)")
def ranking_overlap(spark, sf_dir):
    """How much two rankings' ten best agree."""
    a = S.top(_ranked(spark, sf_dir).withColumn("score", F.round("score", 6)))
    b = S.top(S.cover_density(_index(spark, sf_dir), ("er",), {"title": 1.0, "body": 0.4}).withColumn("score", F.round("score", 6)))
    return S.overlap(a, b)


@query(f"WITH {_INDEX}, h AS (SELECT d.* FROM d WHERE doc_id IN (SELECT doc_id FROM i WHERE term = 'er')) SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM h GROUP BY 2 UNION ALL SELECT 'size', CAST(n_chars // 1000 AS VARCHAR), count(*) FROM h GROUP BY 2")
def facet_counts(spark, sf_dir):
    """Three facets of a query's hits in one pass."""
    hits = _docs(spark, sf_dir).join(S.search(_index(spark, sf_dir), S.Term("er")), "doc_id", "left_semi")
    return S.facets(hits.withColumn("size", F.expr("n_chars div 1000")), ["lang", "source", "size"])


@query(f"WITH {_INDEX} SELECT lang, count(*) AS found, count(*) AS scanned, true AS equal FROM d WHERE doc_id IN (SELECT doc_id FROM i WHERE term = 'er') GROUP BY 1")
def facets_agree(spark, sf_dir):
    """A facet of the index's hits against the same from a scan of the words."""
    docs = _docs(spark, sf_dir)
    found = docs.join(S.search(_index(spark, sf_dir), S.Term("er")), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("found"))
    has = F.exists(S.analyse(F.concat_ws("\n", "title", "body")), lambda x: x["term"] == "er")
    scanned = docs.where(has).groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("scanned"))
    both = found.join(scanned, F.col("lang").eqNullSafe(F.col("_lang")), "full")
    return both.select(F.coalesce("lang", "_lang").alias("lang"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("scanned", F.lit(0)).alias("scanned"), F.col("found").eqNullSafe(F.col("scanned")).alias("equal"))


@query("SELECT g.i AS bucket, count(d.doc_id) AS n FROM (SELECT unnest(range(0, (SELECT CAST(max(n_chars) AS BIGINT) + 1 FROM documents), 2000)) AS i) g LEFT JOIN documents d ON d.n_chars >= g.i AND d.n_chars < g.i + 2000 GROUP BY 1")
def range_facets(spark, sf_dir):
    """A4: lengths in steps of 2000 up to the longest, empty steps too."""
    docs = table(spark, sf_dir, "documents")
    longest = docs.agg(F.max("n_chars")).first()[0]
    return S.range_facet(docs, "n_chars", 0, (longest or 0) + 1, 2000)


@query(f"WITH {_INDEX} SELECT DISTINCT term, levenshtein(term, 'reserve') AS distance FROM i WHERE levenshtein(term, 'reserve') <= 2 AND regexp_full_match(term, '[a-z0-9]+')")
def fuzzy_vocabulary(spark, sf_dir):
    """Terms within two edits."""
    return S.fuzzy_terms(_index(spark, sf_dir).terms.where(F.col("term").rlike("^[a-z0-9]+$")), "reserve").select("term", F.col("distance").cast("long").alias("distance"))


@query(f"WITH {_INDEX} SELECT DISTINCT doc_id FROM i WHERE levenshtein(term, 'reserve') <= 2 AND regexp_full_match(term, '[a-z0-9]+')")
def fuzzy_documents(spark, sf_dir):
    """Documents with such a term."""
    index = _index(spark, sf_dir)
    return S.fuzzy_search(S.Index(index.postings, index.terms.where(F.col("term").rlike("^[a-z0-9]+$")), index.sizes), "reserve")


@query(f"WITH {_INDEX}, q AS (SELECT list_distinct(list_transform(range(1, length('  reserved ') - 1), lambda k: substr('  reserved ', k, 3))) AS q), t AS (SELECT term, list_distinct(list_transform(range(1, length(term) + 2), lambda k: substr('  ' || term || ' ', k, 3))) AS g FROM (SELECT DISTINCT term FROM i)) SELECT term, round(len(list_intersect(g, q)) / len(q), 6) AS similarity FROM t, q WHERE len(list_intersect(g, q)) / len(q) >= 0.6")
def trigram_similarity(spark, sf_dir):
    """R11."""
    return S.word_similarity(_index(spark, sf_dir).terms, "reserved").withColumn("similarity", F.round("similarity", 6))


_GRAMS = """g AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))) AS g FROM d),
q AS (SELECT list_distinct(list_transform(range(1, length('  thanedbl ') - 1), lambda k: substr('  thanedbl ', k, 3))) AS q),
c AS MATERIALIZED (SELECT doc_id, g, q FROM g, q WHERE len(list_intersect(g, q)) >= 0.6 * len(q)),
a AS MATERIALIZED (SELECT doc_id, i, q, hit, coalesce(lag(i) OVER (PARTITION BY doc_id, x ORDER BY i), 0) AS before FROM (SELECT doc_id, q, i, g[i] AS x, list_contains(q, g[i]) AS hit FROM (SELECT doc_id, g, q, unnest(range(1, len(g) + 1)) AS i FROM c))),
e AS (SELECT doc_id, i, i AS j, len(q) AS size, 1 AS n, 1 AS m FROM a WHERE hit
  UNION ALL SELECT e.doc_id, e.i, a.i, e.size, n + CAST(before < e.i AS INT), m + CAST(hit AND before < e.i AS INT) FROM e JOIN a ON a.doc_id = e.doc_id AND a.i = e.j + 1 WHERE (n + CAST(before < e.i AS INT)) * 0.6 <= e.size)"""


@query(f"WITH RECURSIVE {_INDEX}, {_GRAMS} SELECT doc_id, round(max(m / (size + n - m)), 6) AS similarity FROM e GROUP BY 1 HAVING max(m / (size + n - m)) >= 0.6")
def misspelt_titles(spark, sf_dir):
    """Titles with a run of trigrams like those of a misspelt word."""
    return S.similar_titles(_docs(spark, sf_dir), "title", "thanedbl").withColumn("similarity", F.round("similarity", 6))


@query(rf"""WITH {_BM25}, top AS (SELECT doc_id FROM (SELECT doc_id, round(score, 6) AS s FROM r) ORDER BY s DESC, doc_id LIMIT 10),
h AS MATERIALIZED (SELECT doc_id, field, term, pos FROM i WHERE term IN ('er', 'th', 'onnd') AND doc_id IN (SELECT doc_id FROM top)),
u AS (SELECT a.doc_id, a.field, a.pos, count(DISTINCT b.term) AS terms, count(*) AS n, max(b.pos) AS last FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos BETWEEN a.pos AND a.pos + 24 GROUP BY 1, 2, 3),
b AS (SELECT doc_id, field, arg_min({{'p': pos, 'l': last}}, (-terms, -n, last - pos, pos)) AS run FROM u GROUP BY 1, 2), p AS (SELECT doc_id, field, list(pos) AS hits FROM h GROUP BY 1, 2),
tx AS (SELECT doc_id, 'body' AS field, body AS x FROM d JOIN top USING (doc_id) UNION ALL SELECT doc_id, 'title', title FROM d JOIN top USING (doc_id)),
c AS (SELECT doc_id, field, hits, run, regexp_extract_all(x, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS parts FROM tx LEFT JOIN b USING (doc_id, field) LEFT JOIN p USING (doc_id, field)),
e AS (SELECT doc_id, field, hits, parts, run, least(greatest(coalesce(run.l, 0) + 1, coalesce(run.p, 0) + 12), len(parts)) AS stop FROM c),
f AS (SELECT doc_id, field, hits, parts, stop, greatest(least(coalesce(run.p, 0), stop - 12), 0) AS begin FROM e),
g AS (SELECT doc_id, field, hits, regexp_replace(array_to_string(list_transform(range(begin, stop), lambda k: CASE WHEN list_contains(hits, k) THEN regexp_replace(parts[k + 1], '^([\p{{L}}\p{{N}}]+)', '<em>\1</em>') ELSE parts[k + 1] END), ''), '[^\p{{L}}\p{{N}}>]+$', '') AS fragment FROM f)
SELECT doc_id, arg_min(fragment, (hits IS NULL, field = 'title')) AS fragment FROM g GROUP BY 1""")
def highlighted_hits(spark, sf_dir):
    """The best fragment of 12 to 25 words of the ten best documents, its hits marked; from
    the title where the body has no hit."""
    top = S.top(_ranked(spark, sf_dir).withColumn("score", F.round("score", 6)))
    docs = _docs(spark, sf_dir).join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi")
    texts = docs.select("doc_id", "body").select("doc_id", F.lit("body").alias("field"), F.col("body").alias("text")).unionAll(docs.select("doc_id", F.lit("title"), "title"))
    found = S.best_fragments(_index(spark, sf_dir), written(texts), tuple(_TERMS))  # two texts for each of ten documents
    return found.groupBy("doc_id").agg(F.min_by("fragment", F.struct(F.col("n") == 0, F.col("field") == "title")).alias("fragment"))


@query(f"""WITH {_INDEX}, s AS (SELECT unnest([10, 50, 100]) AS percent), n AS (SELECT max(doc_id) + 1 AS n FROM documents),
p AS (SELECT percent, doc_id, contains(text, 'er') AS scanned FROM s, n, documents WHERE doc_id * 100 < n * percent), h AS (SELECT DISTINCT doc_id FROM i WHERE term = 'er')
SELECT percent, count(*) AS docs, count(*) FILTER (scanned) AS scanned, count(h.doc_id) AS found FROM p LEFT JOIN h USING (doc_id) GROUP BY 1""")
def prefix_scaling(spark, sf_dir):
    """Hits of a scan and of the index in the first 10, 50 and 100 % of the ids."""
    docs = table(spark, sf_dir, "documents")
    n = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    found = S.search(_index(spark, sf_dir), S.Term("er")).withColumn("hit", F.lit(1))
    rows = docs.select("doc_id", F.contains("text", F.lit("er")).alias("scanned")).join(found, "doc_id", "left")
    shares = F.filter(F.array(F.lit(10), F.lit(50), F.lit(100)), lambda p: F.col("doc_id") * 100 < p * n)
    rows = rows.select("scanned", "hit", F.explode(shares).alias("percent"))
    return rows.groupBy("percent").agg(F.count("*").alias("docs"), F.count_if("scanned").alias("scanned"), F.count("hit").alias("found"))
