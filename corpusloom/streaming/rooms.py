"""Live rooms: sequence numbers, bounded replay, presence and materialised state.

Batch forms work on a log; ``stream_sequence`` assigns the numbers in a stream with state per room, and ``stream_presence`` prunes
idle participants by processing-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RING = 500
IDLE_SECONDS = 3600
#: Events that take a number but are not kept.
TRANSIENT = ("cursor.moved", "typing", "presence.heartbeat")


def room_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS room_id", "event_id", "event_type", "ts", "value")


def sequence(events: DataFrame) -> DataFrame:
    """Numbers 1, 2, ... in each room by time."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("room_id").orderBy("ts", "event_id")).cast("long"))


def ring(log: DataFrame, size: int = RING, transient: tuple[str, ...] = ()) -> DataFrame:
    """The last ``size`` kept events of each room, with the number up to which events were dropped."""
    kept = log.where(~F.col("event_type").isin(*transient)) if transient else log
    rank = F.row_number().over(Window.partitionBy("room_id").orderBy(F.desc("seq")))
    ranked = kept.withColumn("_rank", rank)
    dropped = F.coalesce(F.max(F.when(F.col("_rank") > size, F.col("seq"))).over(Window.partitionBy("room_id")), F.lit(0))
    return ranked.withColumn("dropped_through", dropped).where(F.col("_rank") <= size).drop("_rank")


def replay(kept: DataFrame, cursors: DataFrame) -> DataFrame:
    """What each reader (room_id, last_event_id) gets; resync where the ring no longer reaches back to its cursor. Cursors are held
    within 0 and the last number."""
    top = kept.groupBy("room_id").agg(F.max("seq").alias("_top"))
    c = cursors.join(top, "room_id").withColumn("cursor", F.least(F.greatest(F.col("last_event_id"), F.lit(0)), F.col("_top"))).drop("_top")
    return kept.join(c, "room_id").where(F.col("seq") > F.col("cursor")).withColumn("resync", F.col("cursor") < F.col("dropped_through"))


def presence(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Stays in a room: from the first event to the last plus the idle time."""
    w = F.session_window("ts", f"{idle_seconds} seconds")
    return events.groupBy("room_id", w.alias("w")).agg(F.count("*").alias("n")).select("room_id", F.col("w.start").alias("joined"), F.col("w.end").alias("pruned"), "n")


def room_state(log: DataFrame) -> DataFrame:
    """Highlights and comments as they stand: (room_id, kind, item_id, payload, anchor).

    log: room_id, seq, event_type (highlight.added, highlight.removed, comment.added, comment.updated, comment.removed), item_id,
    payload, anchor. Removing a highlight leaves its comments without anchor.
    """
    kind = F.split("event_type", r"\.")[0]
    last = log.withColumn("kind", kind).groupBy("room_id", "kind", "item_id").agg(F.max_by("event_type", "seq").alias("last"), F.max_by("payload", "seq").alias("payload"), F.max_by("anchor", "seq").alias("anchor"))
    live = last.where(~F.col("last").endswith(".removed")).drop("last")
    marks = live.where("kind = 'highlight'").select(F.col("room_id").alias("_room"), F.col("item_id").alias("_mark"))
    out = live.join(marks, (F.col("room_id") == F.col("_room")) & (F.col("anchor") == F.col("_mark")), "left").drop("_room")
    return out.withColumn("anchor", F.col("_mark")).drop("_mark")


def format_sse(df: DataFrame) -> DataFrame:
    """Server-sent event frames: a comment for heartbeats, else id, event and data lines."""
    data = F.to_json(F.struct(*[c for c in df.columns if c not in ("seq", "event_type")]))
    frame = F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), F.col("event_type"), F.lit("\ndata: "), data, F.lit("\n\n"))
    return df.withColumn("frame", F.when(F.col("event_type") == "heartbeat", F.lit(": heartbeat\n\n")).otherwise(frame))


def stream_sequence(events: DataFrame) -> DataFrame:
    """Numbers in each room as events arrive (room_id long, event_id long, event_type string), with state per room."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values("event_id", kind="stable")
            yield pd.DataFrame({"room_id": key[0], "event_id": f["event_id"].to_numpy(), "event_type": f["event_type"].to_numpy(), "seq": range(last + 1, last + 1 + len(f))})
            last += len(f)
        state.update((last,))

    return events.groupBy("room_id").applyInPandasWithState(number, "room_id long, event_id long, event_type string, seq long", "last long", "append", GroupStateTimeout.NoTimeout)


def stream_presence(events: DataFrame, idle_seconds: int = IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Stays in a stream, closed when the watermark passes the idle time."""
    return presence(events.withWatermark("ts", late), idle_seconds)


def stream_operations(ops: DataFrame, late: str = "1 day") -> DataFrame:
    """Replicated operations (with a timestamp ``at``) once each, however often they are delivered within ``late``."""
    return ops.withWatermark("at", late).dropDuplicatesWithinWatermark(["op_id"])
