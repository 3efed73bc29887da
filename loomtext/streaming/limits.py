"""Rate limits over request logs, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests that a client may have accepted within the window of seconds.
REQUESTS, SECONDS = 6, 2.0


def accept(times: list[float], kept: list[float], requests: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Decisions for times in order: a request is accepted if fewer than
    ``requests`` accepted ones are younger than the window; rejected ones don't count."""
    out = []
    for t in times:
        kept = [k for k in kept if t - k < seconds]
        out.append(len(kept) < requests)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limited(log: DataFrame, client: str, time: str, event: str, requests: int = REQUESTS, seconds: float = SECONDS) -> DataFrame:
    """(client, event, accepted) of every request, each client in time order. A
    client's requests stream through one sorted partition: the state is at most
    ``requests`` times, however many the client sends."""
    rows = log.select(F.col(client).alias("client"), F.col(event).alias("event"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    dealt = rows.repartition("client").sortWithinPartitions("client", "t", "event")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for pdf in batches:
            out, times, clients = [], (pdf["t"] / 1e6).tolist(), pdf["client"].to_numpy()
            begun = [0, *(np.flatnonzero(clients[1:] != clients[:-1]) + 1).tolist(), len(pdf)]
            for a, b in zip(begun[:-1], begun[1:], strict=True):
                if a < b and clients[a] != now:
                    now, kept = clients[a], []
                decision, kept = accept(times[a:b], kept, requests, seconds)
                out += decision
            yield pd.DataFrame({"client": pdf["client"], "event": pdf["event"], "accepted": out})

    return dealt.mapInPandas(run, f"client {log.schema[client].dataType.simpleString()}, event {log.schema[event].dataType.simpleString()}, accepted boolean")


def rate_limit_stream(log: DataFrame, client: str, time: str, event: str, requests: int = REQUESTS, seconds: float = SECONDS, delay: str = "1 hour") -> DataFrame:
    """The same over a stream; the accepted times, at most ``requests``, are each
    client's state, which is dropped once the watermark (``delay`` behind the latest
    request) has passed them. A client's requests of one micro-batch are sorted
    in memory as times and ids: bound what a batch reads (maxFilesPerTrigger)."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        parts = [(f["t"].to_numpy(), f["event"].to_numpy()) for f in frames]
        t, event = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((event, t))
        decisions, kept = accept((t[order] / 1e6).tolist(), kept, requests, seconds)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((kept[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1) if kept else state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame({"client": key[0], "event": event[order], "accepted": decisions})

    log = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    rows = log.select(F.col(client).cast("long").alias("client"), F.col(event).cast("long").alias("event"), F.unix_micros(time).alias("t"), time)
    return rows.groupBy("client").applyInPandasWithState(run, "client long, event long, accepted boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def window_load(log: DataFrame, client: str, time: str, seconds: float = SECONDS) -> DataFrame:
    """Requests of the client within the window before each (an upper bound of
    what counts against the limit)."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    return log.withColumn("load", F.count("*").over(W.partitionBy(client).orderBy(t).rangeBetween(-int(seconds * 1e6) + 1, 0)))


def paced(log: DataFrame, client: str, time: str, gap: float) -> DataFrame:
    """Rows at least ``gap`` seconds after the client's row before."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    before = F.lag(t).over(W.partitionBy(client).orderBy(t))
    return log.withColumn("_gap", t - before).where(F.col("_gap").isNull() | (F.col("_gap") >= int(gap * 1e6))).drop("_gap")


def distinct_stream(log: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """First rows of each key of a stream; keys are forgotten after the delay."""
    return log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(log: DataFrame, time: str, by: str, length: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows of each window and group; with a delay late rows are dropped."""
    rows = log.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, delay) if delay else rows
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(log: DataFrame, by: str, time: str, gap: str, delay: str | None = None) -> DataFrame:
    """start, end (the gap after the last row) and n of each group's sessions: rows at most the gap
    apart. Over a stream, ``delay`` says how late a row may come: until then it joins sessions, or
    makes two of them one; sessions whose end the watermark has passed are put out and forgotten."""
    rows = log.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, delay) if delay else rows
    found = rows.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
