"""Watched pages, rate limits and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(polls: DataFrame) -> DataFrame:
    """Polls whose content differs from the watch's poll before; a first poll is no change. polls: watch_id, event_id, polled_at, content."""
    w = Window.partitionBy("watch_id").orderBy("polled_at", "event_id")
    h = polls.withColumn("hash", F.sha2("content", 256)).withColumn("_last", F.lag("hash").over(w))
    return h.where(F.col("_last").isNotNull() & (F.col("hash") != F.col("_last"))).drop("_last")


def stream_changes(polls: DataFrame) -> DataFrame:
    """``changes`` in a stream of polls (watch_id long, event_id long, content string), with the last hash as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def detect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values("event_id", kind="stable")
            before = [last, *f["hash"].tolist()[:-1]]
            changed = [b is not None and b != h for b, h in zip(before, f["hash"], strict=True)]
            last = f["hash"].iloc[-1]
            yield f[changed][["watch_id", "event_id", "hash"]]
        state.update((last,))

    hashed = polls.select("watch_id", "event_id", F.sha2("content", 256).alias("hash"))
    return hashed.groupBy("watch_id").applyInPandasWithState(detect, "watch_id long, event_id long, hash string", "last string", "append", GroupStateTimeout.NoTimeout)


def rate_limit(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Marks events beyond ``most`` in the sliding ``seconds`` up to them."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("limited", F.count("*").over(w) > most)


def breaker(calls: DataFrame, key: str = "service", failures: int = 5) -> DataFrame:
    """Length of the run of failures up to each call, and whether it opens the breaker. calls: service, at, ok."""
    w = Window.partitionBy(key).orderBy("at")
    run = calls.withColumn("_reset", F.sum(F.col("ok").cast("int")).over(w))
    n = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(key, "_reset").orderBy("at"))
    return run.withColumn("failures", n).withColumn("opens", F.col("failures") == failures).drop("_reset")


def hit_rate(requests: DataFrame) -> DataFrame:
    return requests.groupBy("namespace").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))
