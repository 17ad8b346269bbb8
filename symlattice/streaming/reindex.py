"""Streams: an index that follows a project's files, and sessions that end when their events pause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def follow(engine: Engine, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Bring the index up to date at each tick; without changes that is one scan.

    A stream of files tells neither what was deleted nor what changed under a known path, so a clock is the source and the
    fingerprints say what happened. A tick during another's build leaves the work to the next one.
    """
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def update(_: DataFrame, __: int) -> None:
        try:
            engine.reindex()
        except BlockingIOError:
            pass

    return ticks.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """(key, session, n_events) of a stream: a session ends when nothing came for ``gap``; later events than ``late`` go."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n_events"))


def merged_deltas(deltas: DataFrame, key: str, order: str, text: str, ts: str, late: str = "1 minute", gap: str = "3 seconds") -> DataFrame:
    """Each message's deltas in order, once it has paused for ``gap``."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    whole = F.array_join(F.transform(parts, lambda x: x[text]), "")
    return deltas.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("session")).agg(whole.alias("content"))
