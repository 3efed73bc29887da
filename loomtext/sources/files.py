"""Readers and writers of the formats that catalogues and corpora come in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_envelope(spark: SparkSession, path: str, records: str, schema: T.StructType | None = None) -> DataFrame:
    """Records of a JSON document that holds them in one array."""
    reader = spark.read.option("multiLine", True)
    whole = (reader.schema(schema) if schema else reader).json(path)
    return whole.select(F.explode(records).alias("r")).select("r.*")


def first_readable(spark: SparkSession, paths: Iterable[str], records: str) -> DataFrame:
    """The first path of a fallback chain that can be read."""
    last: Exception | None = None
    for path in paths:
        try:
            return read_envelope(spark, path, records)
        except AnalysisException as e:
            last = e
    raise last or ValueError("no path given")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header and perhaps a byte-order mark; columns by position."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True, encoding="UTF-8")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """One JSON record per line, gzip too (not splittable, so dealt again)."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(partitions) if partitions else rows


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path and value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_embeddings(spark: SparkSession, path: str, vocabulary: DataFrame, width: int) -> DataFrame:
    """(word, vec) of the vocabulary's words from lines "word v1 ... vn"; another
    number of values is an error."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    rows = parts.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, 1_000_000), lambda x: x.cast("float")).alias("vec"))
    wanted = rows.join(vocabulary, "word", "left_semi")
    return wanted.withColumn("vec", F.when(F.size("vec") == width, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("wrong width: "), "word"))))


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a table read from files, by the files' numbers and the rows' places in them; a scan of
    places finds them, and each task keeps n at most."""
    path = F.col("_metadata.file_path")
    number = F.lpad(F.regexp_extract(path, r"part-(\d+)[^/]*$", 1), 12, "0")
    placed = df.select("*", F.struct(number, path, F.col("_metadata.row_index")).alias("_place"))
    return placed.orderBy("_place").limit(n).drop("_place")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV parts with a header; null is empty."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    """One JSON record per line; null fields are left out."""
    df.write.mode("overwrite").json(path, compression=compression)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small table as Markdown; the limit is the report's."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
