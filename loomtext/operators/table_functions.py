"""Table functions: rows that stand beside each row of a query, and runs of partitioned input.

``EditSteps`` is joined laterally: each pair of texts is followed by the steps of a cheapest edit. ``Runs``
takes a table that is partitioned and sorted; it sees one row at a time and keeps one run, so a partition
of any size costs the memory of a row. ``register`` makes both callable from SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..functions.similarity import edit_script


@udtf(returnType="step: int, operation: string, before: string, after: string")
class EditSteps:
    """edit_steps(a, b): step (from 1), operation, and the letters before and after it; no
    rows for null texts, nor for two empty ones."""

    def eval(self, a: str, b: str):
        if a is not None and b is not None:
            for k, (operation, x, y) in enumerate(edit_script(a, b), 1):
                yield k, operation, x, y


@udtf(returnType="part: string, run: int, first: bigint, last: bigint, rows: bigint")
class Runs:
    """runs(TABLE(part, key, value) PARTITION BY part ORDER BY key): the longest stretches of rows
    whose values never fall: their number in the partition (from 1), first and last key and how many
    rows they have. A null value is a run of its own."""

    def __init__(self):
        self._part = self._first = self._last = self._value = None
        self._run = self._rows = 0

    def eval(self, row):
        goes = self._rows and row["value"] is not None and self._value is not None and row["value"] >= self._value
        if not goes:
            if self._rows:
                yield self._part, self._run, self._first, self._last, self._rows
            self._part, self._run, self._first, self._rows = row["part"], self._run + 1, row["key"], 0
        self._last, self._value = row["key"], row["value"]
        self._rows += 1

    def terminate(self):
        if self._rows:
            yield self._part, self._run, self._first, self._last, self._rows


def register(spark: SparkSession) -> None:
    """The functions edit_steps and runs of SQL."""
    spark.udtf.register("edit_steps", EditSteps)
    spark.udtf.register("runs", Runs)


def edit_steps(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs, a row for each step between the columns a and b."""
    from pyspark.sql import functions as F

    return pairs.lateralJoin(EditSteps(F.col(a).outer(), F.col(b).outer()))


def rising_runs(rows: DataFrame, part: Column, key: Column, value: Column) -> DataFrame:
    """Runs of rows whose values never fall, in the order of the key (see ``Runs``)."""
    table = rows.select(part.cast("string").alias("part"), key.cast("long").alias("key"), value.alias("value"))
    return Runs(table.asTable().partitionBy("part").orderBy("key"))
