"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._store import bounded_batches


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if the table has that column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_arrow_columns(
    df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]
) -> DataFrame:
    """All columns of df and new ones that ``make`` computes batch by batch.
    A column of df that has a new one's name is replaced."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, added in make(batch):
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + added, names=names + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(kept + fields))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, wherever Spark can read it."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(df: DataFrame, column: str):
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Rows of a few numbers that may be broadcast (some tens of MB at most).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows; beyond that df
    as it is, so that Spark shuffles. ``rows``: the count, if it is known."""
    n = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= most else df
