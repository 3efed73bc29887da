"""Where operators keep tables between jobs: the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import stored

#: Rows of an Arrow batch.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold whole documents: BATCH_ROWS rows at once instead of Spark's
    default keep the executors' buffers small. A session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The table written as Parquet to the shared folder and read again: later
    jobs start from the files, whichever executors are lost."""
    bounded_batches(df.sparkSession)
    return stored.written(df, compression)
