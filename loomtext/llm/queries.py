"""The operators of this subpackage as registered queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, html, licences, materialise, merkle, mixing, ngram_join, quality, token_counts, topk, toxicity, vector_codes
from ._frames import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best window."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity probabilities of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mix by the square roots of the sources' sizes."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
    parts = (F.col(f"mix.{c}").alias("mix_order" if c == "order" else c) for c in ("rank", "block", "cycle", "slot", "release", "deadline", "order"))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), *parts)


def op4_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one that holds control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences in their training slots."""
    return materialise.materialise(table(spark, sf_dir, "documents"))


def op7_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document."""
    found = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").alias("n_detections"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document; one leaf in seven is tampered with."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": more})


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector, and the error of its label."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_toxicity_chain, op3_mix_sources, op4_quality_ftrl, op5_chat_template, op6_token_shards, op7_html_density, op8_exact_topk,
        op9_licence_rules, op10_ngram_jaccard, op11_token_counts, op12_merkle_manifest, op13_filtering_lloyd,
    )
}

#: Where SQL can express the whole result and is quick on whole tables.
ORACLE_SQL: dict[str, str] = {"op3_mix_sources": mixing.ORACLE_SQL, "op8_exact_topk": topk.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_filtering_lloyd": vector_codes.ORACLE_SQL}
