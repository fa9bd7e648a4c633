"""Streaming forms: change events to bursts, incremental index builds, and caches with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.state import debounce

DEBOUNCE = "800 milliseconds"
# Seconds an entry, a resource and a miss are kept.
TTL = {"entry": 300, "resource": 900, "negative": 20}


def relevant(paths: DataFrame, path: str = "path") -> DataFrame:
    """Changes of containers and their settings only (not of what an index build itself writes)."""
    return paths.where(F.lower(path).rlike(r"\.(mdx|mdd|toml)$"))


def bursts(events: DataFrame, ts: str, lateness: str = "1 minute", keys: list[str] | None = None) -> DataFrame:
    """Bursts of a stream of change events, closed by a gap, per key (default: one watch)."""
    if not keys:
        events, keys = events.withColumn("watch", F.lit("all")), ["watch"]
    return debounce(events.withWatermark(ts, lateness), ts, DEBOUNCE, keys)


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Build an index of new files of a folder: each trigger takes what has arrived, and stops."""
    source = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        # the batch number names the folder: a repeated batch replaces its own output
        build(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, rescan: Callable[[], None], seconds: int = 60, once: bool = False):
    """Rescans a folder of containers when files change in it, and every so many seconds in any case; returns the running stream.

    Files are watched by their listing; their content is not read. ``once`` takes what is there and stops.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    seen = relevant(files.select("path", "modificationTime", "length"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rescan()

    stream = seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=f"{seconds} seconds")).start()


def _burst(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Bursts of one watch: relevant events less than the gap apart; an event that is not relevant closes the burst, too."""
    begin, last, n = state.get if state.exists else (None, None, 0)
    out = []
    if state.hasTimedOut:
        if n:
            out.append((begin, last, n))
        state.remove()
    else:
        for rows in batches:
            rows = rows.sort_values("ts")
            for ts, ok in zip(rows["ts"], rows["relevant"]):
                now = ts.timestamp()
                if n and (now - last >= GAP or not ok):
                    out.append((begin, last, n))
                    n = 0
                if ok:
                    begin, last, n = (now if not n else begin), now, n + 1
        state.update((begin or 0.0, last or 0.0, n))
        if n:
            state.setTimeoutTimestamp(int((last + GAP) * 1000) + 1 + max(0, state.getCurrentWatermarkMs() - int(last * 1000)))
    times = lambda xs: pd.to_datetime([round(x * 1e6) for x in xs], unit="us")
    yield pd.DataFrame({"key": [key[0]] * len(out), "start": times([b for b, _, _ in out]), "stop": times([x for _, x, _ in out]), "n": [k for *_, k in out]})


GAP = 0.8


def debounced(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """key, start, stop, n of a stream of events(key, ts, relevant): bursts, closed by a gap or by an event that is not relevant."""
    return events.withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(
        _burst, "key string, start timestamp, stop timestamp, n long", "begin double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def _cache(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hit or miss of each request of one key: a value lives for its time since it was written, and its state no longer than that."""
    if state.hasTimedOut:
        state.remove()
        return
    until = state.get[0] if state.exists else -1.0
    for b in batches:
        rows = b.sort_values("ts")
        hits = []
        for ts, ttl in zip(rows["ts"], rows["ttl"]):
            now = ts.timestamp()
            hit = now < until
            if not hit:
                until = now + float(ttl)
            hits.append(hit)
        yield pd.DataFrame({"key": [key[0]] * len(hits), "ts": rows["ts"].to_numpy(), "hit": hits})
    state.update((until,))
    state.setTimeoutTimestamp(max(int(until * 1000) + 1, state.getCurrentWatermarkMs() + 1))


#: Seconds a request may be late.
LATENESS = 60


def _kept(requests: DataFrame) -> DataFrame:
    """With a watermark LATENESS behind the latest request; of a time moved forward, as a stream drops what is not after its epoch."""
    return requests.withColumn("_w", F.col("ts") + F.make_dt_interval(secs=F.lit(LATENESS))).withWatermark("_w", f"{2 * LATENESS} seconds")


def ttl_cache(requests: DataFrame) -> DataFrame:
    """key, ts, hit of a stream of requests(key, ts, ttl)."""
    return _kept(requests).groupBy("key").applyInPandasWithState(_cache, "key string, ts timestamp, hit boolean", "until double", "append", GroupStateTimeout.EventTimeTimeout)


def _misses(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Whether each request is answered by a remembered miss: written when nothing is found, cleared by a hit, gone after a while."""
    if state.hasTimedOut:
        state.remove()
        return
    until = state.get[0] if state.exists else -1.0
    for b in batches:
        rows = b.sort_values("ts")
        known = []
        for ts, found in zip(rows["ts"], rows["found"]):
            now = ts.timestamp()
            known.append(now < until)
            if now >= until:
                until = -1.0 if found else now + TTL["negative"]
        yield pd.DataFrame({"key": [key[0]] * len(known), "ts": rows["ts"].to_numpy(), "known_miss": known})
    if until < 0:
        state.remove()
    else:
        state.update((until,))
        state.setTimeoutTimestamp(max(int(until * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def negative_cache(requests: DataFrame) -> DataFrame:
    """key, ts, known_miss of a stream of requests(key, ts, found)."""
    return _kept(requests).groupBy("key").applyInPandasWithState(_misses, "key string, ts timestamp, known_miss boolean", "until double", "append", GroupStateTimeout.EventTimeTimeout)
