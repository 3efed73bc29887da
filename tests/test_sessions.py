"""Sessions with late rows: a stream against what its watermark lets in."""

import random

from pyspark.sql import functions as F

from loomtext.streaming import limits


def sessions(rows, gap):
    """(client, start, end, n) of rows (client, t)."""
    out = []
    for client in sorted({c for c, _ in rows}):
        now = []
        for t in sorted(t for c, t in rows if c == client):
            if now and t - now[-1] > gap:
                out.append((client, now[0], now[-1] + gap, len(now)))
                now = []
            now.append(t)
        out.append((client, now[0], now[-1] + gap, len(now)))
    return sorted(out)


def seconds(df):
    return sorted((r.client, r.s, r.e, r.n) for r in df.select("client", F.unix_seconds("start").alias("s"), F.unix_seconds("end").alias("e"), "n").collect())


def test_batches_equal_plain_python(spark):
    rng = random.Random(71)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 4000)) for _ in range(300)] + [(9, 0), (9, 60), (9, 119), (9, 179)]
    log = spark.createDataFrame(rows, "client int, t long").select("client", F.timestamp_seconds("t").alias("ts"))
    assert seconds(limits.sessions(log, "client", "ts", "60 seconds")) == sessions(rows, 60)


def test_late_rows_join_sessions_until_the_watermark(spark, tmp_path):
    # the third file's row of client 1 makes two sessions one; the last file's is too late
    files = [[(1, 1000), (1, 1090), (2, 1000)], [(2, 1100), (3, 1150)], [(1, 1045), (2, 1050), (3, 1160)], [(3, 2000), (4, 2400)], [(5, 4000)], [(1, 1010), (6, 9000)]]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in files:
        spark.createDataFrame(rows, "client int, t long").select("client", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("client int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    query = limits.sessions(stream, "client", "ts", "60 seconds", "5 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [r for rows in files for r in rows if r != (1, 1010)]
    last = max(t for _, t in kept)
    assert seconds(spark.read.parquet(out)) == [s for s in sessions(kept, 60) if s[2] <= last - 300]
