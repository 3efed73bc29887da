"""Tables that are kept between jobs, in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset (tests on one
    machine), a local folder is made and set as the checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = getattr(spark.sparkContext, "_loomtext_folder", None)
    if local is None:
        local = spark.sparkContext._loomtext_folder = tempfile.mkdtemp(prefix="loomtext-")
        spark.sparkContext.setCheckpointDir(local)
    return local


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/loomtext-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The table written as Parquet to the shared folder and read again: later
    jobs start from the files, whichever executors are lost."""
    path = new_path(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(spark: SparkSession, path: str) -> int:
    """The bytes of a table's files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


#: Files that the driver lists by itself; more are listed by a job.
_LISTED = 1000


def version(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    files: list[tuple[str, int, int]] | None = []
    while found.hasNext():
        if len(files) >= _LISTED:
            files = None
            break
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    if files is None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_millis("modificationTime").alias("time")).collect()
        files = [tuple(r) for r in rows]
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:24]


def kept(spark: SparkSession, path: str, name: str, make: Callable[[str], None]) -> str:
    """The folder of what ``make`` writes to it from this version of the table at
    ``path``; made once and then reused by all queries of the application."""
    made = spark.sparkContext.__dict__.setdefault("_loomtext_kept", {})
    key = (name, path, version(spark, path))
    if key not in made:
        folder = new_path(spark)
        make(folder)
        made[key] = folder
    return made[key]
