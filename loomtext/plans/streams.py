"""Queries over the event log, as batches and as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.stored import new_path
from ..streaming import limits as L
from ._register import query, table

_T = "epoch_us(ts)"


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there and returns what it has put out: files in
    the shared folder, beside the stream's checkpoint."""
    path = new_path(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


_LIMITED = f"""WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS event, {_T} / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS rn FROM events),
r AS (SELECT client, event, rn, true AS accepted, [t] AS kept FROM e WHERE rn = 1
  UNION ALL SELECT client, event, rn, len(k) < 2, CASE WHEN len(k) < 2 THEN list_append(k, t) ELSE k END
  FROM (SELECT e.client, e.event, e.rn, e.t, list_filter(r.kept, lambda x: e.t - x < 3600) AS k FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1))
SELECT client, event, accepted FROM r"""


@query(_LIMITED)
def rate_limit(spark, sf_dir):
    """Decisions for every event, two per hour and user."""
    return L.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", requests=2, seconds=3600.0)


@query(_LIMITED)
def rate_limit_as_stream(spark, sf_dir):
    """T1 with state across micro-batches."""
    return drained(L.rate_limit_stream(_stream(spark, sf_dir), "user_id", "ts", "event_id", requests=2, seconds=3600.0))


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {_T} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS load FROM events")
def rate_window_load(spark, sf_dir):
    """T1, upper bound."""
    return L.window_load(table(spark, sf_dir, "events"), "user_id", "ts", 3600.0).select("event_id", "load")


@query(f"SELECT event_id FROM (SELECT event_id, {_T} - lag({_T}) OVER (PARTITION BY user_id ORDER BY {_T}) AS gap FROM events) WHERE gap IS NULL OR gap >= 600000000")
def paced_requests(spark, sf_dir):
    """T2."""
    return L.paced(table(spark, sf_dir, "events"), "user_id", "ts", 600.0).select("event_id")


@query("SELECT DISTINCT user_id FROM events")
def first_seen_stream(spark, sf_dir):
    """Distinct users of a stream. The seen set forgets a user a day after the last event; who comes
    back later is met among the few rows that the stream has put out."""
    return drained(L.distinct_stream(_stream(spark, sf_dir).select("user_id", "ts"), "user_id", "ts", "1 day").select("user_id")).distinct()


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    """Extension: hourly windows."""
    return L.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


_SESSIONS = f"""WITH s AS (SELECT user_id, {_T} AS t, CASE WHEN {_T} - lag({_T}) OVER w <= 1800000000 THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_T})),
r AS (SELECT user_id, t, sum(begins) OVER (PARTITION BY user_id ORDER BY t, begins DESC ROWS UNBOUNDED PRECEDING) AS k FROM s),
o AS (SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM r GROUP BY user_id, k)"""


def _in_micros(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"{_SESSIONS} SELECT user_id, start_us, end_us, n FROM o")
def session_windows(spark, sf_dir):
    """Extension: sessions of each user, half an hour apart."""
    return _in_micros(L.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes"))


@query(f"{_SESSIONS} SELECT user_id, start_us, end_us, n FROM o WHERE end_us <= (SELECT max({_T}) FROM events) - 3600000000")
def session_windows_as_stream(spark, sf_dir):
    """Extension: the sessions that a stream has closed, with rows up to an hour late."""
    return _in_micros(drained(L.sessions(_stream(spark, sf_dir).select("user_id", "ts"), "user_id", "ts", "30 minutes", "1 hour")))


@query(f"WITH w AS (SELECT event_type, unnest(range(({_T} // 900000000 - 3) * 900000000, ({_T} // 900000000 + 1) * 900000000, 900000000)) AS start_us FROM events) SELECT start_us, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    """Extension: windows of an hour that begin every quarter."""
    found = L.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "15 minutes")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n")
