"""A corpus pipeline of five stages, each one operator of loomtext.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next. All stages but the last return the columns of
documents. The mixing stage writes its rows in the order of the mix, in the order of
its files' numbers and the rows in them. The token stage packs the rows in that order
and permutes sequences inside stretches of ``WINDOW`` of them, so each stretch of
slots holds the sources in the shares of the mix.

Defined results, for each stage: null and empty texts are scored by the bias of
the quality model; what it keeps of them are no copies of others, hold no benchmark
item, take a place in the mix and give an end-of-text id; a row without an id is
judged by its own text; rows that repeat (id and text) become one in the near-duplicate
stage, of equal texts the smallest id stays; ties of quality scores don't matter
(rows are kept by a threshold); a null source is the source with the empty name;
very long texts are read whole; other columns of docs, whatever their names, go
through all stages but the last; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, materialise, mixing, ngram_join, quality
from loomtext.llm._frames import table
from loomtext.llm._store import written

#: Sequences of the token stream that are permuted among themselves (8 shards).
WINDOW = 8 * materialise.SHARD_ROWS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at 0.8."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mix by the square roots of the sources' sizes."""
    return mixing.in_mix_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in their training slots, in the order of docs' files and rows
    but for a permutation inside each window."""
    return materialise.materialise(docs, window=WINDOW)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Trained weights, fingerprints and tokenizers have no SQL: tests/llm compares
#: the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
