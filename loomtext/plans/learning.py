"""Queries of representations, classifiers and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, Word2Vec
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import gradients as G, vectors as V
from ..sources.stored import bytes_of, written
from ._register import query, table

_CLEAN = r"list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_SPLIT = "sp AS (SELECT doc_id, quality, toxic, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 2), md5(CAST(doc_id AS VARCHAR))) <= floor(count(*) OVER (PARTITION BY quality) * 0.8) THEN 'train' ELSE 'test' END AS split FROM labels)"


def _split(spark, sf_dir) -> DataFrame:
    return V.stratified_split(table(spark, sf_dir, "labels"), "quality", F.md5(F.col("doc_id").cast("string")))


def _tokens(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("tokens"), "text")
    return _split(spark, sf_dir).join(docs, "doc_id")


#: Bytes of the documents' files for one part of what is dealt by document, and for one learner of word vectors.
_PART, _LEARNER = 4 << 20, 32 << 20
#: Labels whose ids are broadcast at most.
_IDS = 2_000_000


def _dealt(spark, sf_dir) -> DataFrame:
    """doc_id and tokens of the labelled documents: only their texts are dealt, by doc_id over parts of bounded size,
    and cut into tokens there."""
    parts = max(1, -(-bytes_of(spark, f"{sf_dir}/documents.parquet") // _PART))
    labels = table(spark, sf_dir, "labels").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(labels) if labels.count() <= _IDS else labels, "doc_id")
    return docs.repartition(parts, "doc_id").select("doc_id", X.words(F.col("text")).alias("tokens"))


@query(f"WITH {_SPLIT} SELECT split, quality, count(*) AS n FROM sp GROUP BY 1, 2")
def split_sizes(spark, sf_dir):
    """A32, M1, M14."""
    return _split(spark, sf_dir).groupBy("split", "quality").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT doc_id, unnest({_CLEAN}) AS term FROM documents JOIN labels USING (doc_id)), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM f GROUP BY 1 HAVING count(*) >= 2")
def bag_of_words(spark, sf_dir):
    """M2: terms of at least two labelled documents."""
    tf = V.term_counts(_tokens(spark, sf_dir), "doc_id", F.col("tokens"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 2")


_TFIDF = "f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM f GROUP BY 1 HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {m}), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM f)) / (1 + df)) + 1) AS x FROM f JOIN d USING (term)) SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"


@query(f"WITH t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT doc_id, {_CLEAN} AS w FROM documents JOIN labels USING (doc_id))), {_TFIDF.format(m=50000)}")
def word_tf_idf(spark, sf_dir):
    """M3: words and word pairs."""
    docs = _dealt(spark, sf_dir)
    pairs = docs.withColumn("units", F.concat("tokens", X.joined_ngrams(F.col("tokens"), 2)))
    return V.tf_idf(pairs, "doc_id", F.col("units"))


@query(f"WITH t0 AS (SELECT doc_id, string_split(' ' || w || ' ', '') AS c FROM (SELECT doc_id, unnest({_CLEAN}) AS w FROM documents JOIN labels USING (doc_id))), t AS (SELECT doc_id, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ''))))) AS term FROM t0), {_TFIDF.format(m=50000)}")
def char_tf_idf(spark, sf_dir):
    """M4: runs of three to five letters inside words with a blank at both ends."""
    return V.tf_idf(_dealt(spark, sf_dir), "doc_id", F.col("tokens"), V.letter_runs)


_MICRO = ", ".join(f"CAST(round(coalesce(avg(CAST(vec[{k}] AS DOUBLE)), 0.0) * 1000000) AS BIGINT)" for k in range(1, 65))


@query(f"WITH v AS (SELECT e.user_id, x.embedding AS vec FROM events e LEFT JOIN embeddings x ON x.vec_id = e.event_id % (SELECT 3 * count(*) // 2 FROM embeddings)) SELECT user_id, count(*) AS tokens, count(vec) AS known, array_to_string([{_MICRO}], ',') AS millionths FROM v GROUP BY 1")
def mean_embeddings(spark, sf_dir):
    """The mean vector of each user's events, as far as vectors exist, in millionths."""
    embeddings = table(spark, sf_dir, "embeddings")
    tokens = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % (embeddings.count() * 3 // 2)).alias("w"))
    vectors = embeddings.select(F.col("vec_id").alias("w"), F.col("embedding").alias("vec"))
    m = V.mean_vectors(tokens, vectors, "user_id", 64)
    return m.select("user_id", "tokens", "known", F.array_join(F.transform("vector", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("millionths"))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def standard_scores(spark, sf_dir):
    """M8."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return V.standardise(part, ["p_size", "p_retailprice"]).select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query("WITH q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query, vec_id, label, row_number() OVER (PARTITION BY query ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), vec_id) r FROM embeddings JOIN q ON vec_id <> query), v AS (SELECT query, label, count(*) AS c FROM d WHERE r <= 5 GROUP BY 1, 2) SELECT query, CAST(arg_min(label, (-c, label)) AS INTEGER) AS predicted FROM v GROUP BY 1")
def nearest_neighbour_vote(spark, sf_dir):
    """Five nearest vectors; the queries are every fiftieth row."""
    e = table(spark, sf_dir, "embeddings")
    train = e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("qvec"))
    return V.vote(V.nearest(train, queries, 5)).select("query", F.col("predicted").cast("int").alias("predicted"))


_RULE = "r AS (SELECT d.doc_id, quality, toxic, lang, CASE WHEN regexp_matches(text, '[|%$&!]{2}| \\| ') THEN 0 ELSE 1 END AS predicted FROM documents d JOIN labels USING (doc_id))"


def _rule(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("text").rlike(r"[|%$&!]{2}| \| "), 0).otherwise(1).alias("predicted"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


_EVAL = "count(*) FILTER (quality <> 1 AND predicted <> 1) AS tn, count(*) FILTER (quality <> 1 AND predicted = 1) AS fp, count(*) FILTER (quality = 1 AND predicted <> 1) AS fn, count(*) FILTER (quality = 1 AND predicted = 1) AS tp, round(avg(CASE WHEN quality = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(2 * count(*) FILTER (quality = 1 AND predicted = 1) / (count(*) FILTER (quality = 1) + count(*) FILTER (predicted = 1)), 6) AS f1"


@query(f"WITH {_RULE} SELECT {_EVAL} FROM r")
def confusion(spark, sf_dir):
    """A rule against the labels."""
    return V.evaluate(_rule(spark, sf_dir), "quality", "predicted").withColumns({c: F.round(c, 6) for c in ("accuracy", "f1")})


@query(f"WITH {_RULE} SELECT lang, {_EVAL} FROM r GROUP BY 1")
def errors_by_segment(spark, sf_dir):
    """A27."""
    return V.evaluate(_rule(spark, sf_dir), "quality", "predicted", "lang").withColumns({c: F.round(c, 6) for c in ("accuracy", "f1")})


@query(f"WITH {_RULE} SELECT doc_id, CASE WHEN quality = 1 THEN 'FN' ELSE 'FP' END AS kind FROM r WHERE quality <> predicted")
def misclassified(spark, sf_dir):
    """M16, O10."""
    return _rule(spark, sf_dir).where("quality <> predicted").select("doc_id", F.when(F.col("quality") == 1, "FN").otherwise("FP").alias("kind"))


def _features() -> list:
    return [CountVectorizer(inputCol="tokens", outputCol="tf", minDF=2, vocabSize=30_000), IDF(inputCol="tf", outputCol="w"), Normalizer(inputCol="w", outputCol="features")]


#: Rows times terms of one part that classifiers learn from: trees keep four bytes for each in memory.
_CELLS = 60_000_000


def _bounded(rows: DataFrame, terms: int) -> DataFrame:
    """rows, dealt by doc_id over parts of bounded size with all terms written out."""
    return rows.repartition(max(1, -(-rows.count() * terms // _CELLS)), "doc_id")


@query()
def classifier_table(spark, sf_dir):
    """Four classifiers on tf-idf features, scored on the test split."""
    data = _tokens(spark, sf_dir).withColumn("label", F.col("quality").cast("double"))
    features = Pipeline(stages=_features()).fit(data.where("split = 'train'"))
    prepared = written(features.transform(data).select("doc_id", "split", "label", "features"))
    # the files are small, since terms that a document lacks take no room: read as they are, many would be one task
    train = _bounded(prepared.where("split = 'train'"), len(features.stages[0].vocabulary))
    models = {"LogisticRegression": LogisticRegression(maxIter=20, regParam=0.01), "LinearSVC": LinearSVC(maxIter=20, regParam=0.01), "DecisionTree": DecisionTreeClassifier(maxDepth=4, maxBins=8, seed=1), "RandomForest": RandomForestClassifier(numTrees=10, maxDepth=4, maxBins=8, seed=1)}
    out = None
    for name, model in models.items():
        scored = model.fit(train).transform(prepared.where("split = 'test'"))
        part = V.evaluate(scored, "label", "prediction").select(F.lit(name).alias("classifier"), "*")
        out = part if out is None else out.unionAll(part)
    return out


@query()
def cross_validation(spark, sf_dir):
    """A grid over two stratified folds."""
    data = _tokens(spark, sf_dir).where("split = 'train'").withColumn("label", F.col("quality").cast("double"))
    data = V.stratified_split(data.drop("split"), "quality", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("cv"))), 0.5).withColumn("fold", (F.col("split") == "train").cast("int"))
    prepared = Pipeline(stages=_features()).fit(data).transform(data).select("fold", "label", "features")
    prepared = written(prepared)
    lr = LogisticRegression(maxIter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.1, 0.01]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=2, foldCol="fold").fit(prepared)
    return spark.createDataFrame([(p[lr.regParam], float(f)) for p, f in zip(grid, cv.avgMetrics, strict=True)], "reg_param double, f1 double")


def _learners(size: int, cores: int) -> int:
    """Learners of word vectors for so many bytes: one for small texts, then as many as there are cores, then one for each part."""
    return max(1, min(max(cores, size // _LEARNER), size // (_LEARNER // 4)))


@query()
def word_vectors(spark, sf_dir):
    """M5: averaged skip-gram vectors of the labelled documents, to six decimals. Learners of a bounded part of the
    texts each see all of their words; their vectors are averaged."""
    data = written(_tokens(spark, sf_dir).select("doc_id", "tokens"))  # read for the vocabulary, the vectors and the means
    learners = _learners(bytes_of(spark, f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism)
    model = Word2Vec(vectorSize=16, windowSize=5, minCount=5, maxIter=1, seed=42, numPartitions=learners, inputCol="tokens", outputCol="v").fit(data)
    from pyspark.ml.functions import vector_to_array

    return model.transform(data).select("doc_id", F.transform(vector_to_array("v"), lambda x: F.round(x, 6)).alias("vector"))


@query()
def feature_weights(spark, sf_dir):
    """The ten terms of the largest and of the smallest weight."""
    data = _tokens(spark, sf_dir).where("split = 'train'").withColumn("label", F.col("quality").cast("double"))
    fitted = Pipeline(stages=[*_features(), LogisticRegression(maxIter=20, regParam=0.01)]).fit(data)
    terms, weights = fitted.stages[0].vocabulary, fitted.stages[-1].coefficients.toArray()
    rows = spark.createDataFrame(list(zip(terms, map(float, weights), strict=True)), "term string, weight double")
    return rows.orderBy(F.desc("weight"), "term").limit(10).unionAll(rows.orderBy("weight", "term").limit(10))


#: Buckets of hashed tokens, and random features of the kernel.
BUCKETS, FEATURES = 128, 256


@query()
def gradient_classifiers(spark, sf_dir):
    """Linear and Gaussian-kernel classifiers by mini-batch gradients, scored on the test split."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.lm_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    labelled = _split(spark, sf_dir).select("doc_id", "split", F.col("quality").alias("label"))
    data = written(labelled.join(V.hashed_features(docs.join(labelled, "doc_id", "left_semi"), "doc_id", F.col("t"), BUCKETS), "doc_id").withColumnRenamed("doc_id", "key"))
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    kernel = G.Fourier.draw(BUCKETS, FEATURES, 1.0, seed=42)
    out = None
    for name, loss, features in (("linear hinge", "hinge", None), ("linear log", "log", None), ("kernel hinge", "hinge", kernel)):
        model = G.fit(train, BUCKETS, loss, epochs=4, batches=6, rate=4.0, features=features)
        part = V.evaluate(G.predicted(test, model), "label", "predicted").select(F.lit(name).alias("classifier"), "*")
        out = part if out is None else out.unionAll(part)
    return out
