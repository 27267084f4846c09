"""The change log as a stream, and listeners on it."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshelf.schema import FILES

EVENTS = frozenset("add update delete restore purge duplicate change open close destroy".split())
CHANGES = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("type", T.StringType()), T.StructField("source", T.StringType()), T.StructField("id", T.StringType()), T.StructField("record", FILES)]
)
_log = logging.getLogger(__name__)


class Emitter:
    """Listeners by event. A listener that fails is reported and doesn't stop the others."""

    def __init__(self) -> None:
        self._listeners: defaultdict[str, list[Callable]] = defaultdict(list)

    def on(self, event: str, listener: Callable) -> Callable[[], None]:
        if event not in EVENTS:
            raise ValueError(f"no such event: {event}")
        self._listeners[event].append(listener)
        return lambda: self.off(event, listener)

    def once(self, event: str, listener: Callable) -> Callable[[], None]:
        def run(payload: object) -> None:
            stop()
            listener(payload)

        stop = self.on(event, run)
        return stop

    def off(self, event: str, listener: Callable) -> None:
        if listener in self._listeners[event]:
            self._listeners[event].remove(listener)

    def emit(self, event: str, payload: object = None) -> None:
        for listener in list(self._listeners[event]):
            try:
                listener(payload)
            except Exception:
                _log.exception("a listener of %s failed", event)

    def listener_count(self, event: str) -> int:
        return len(self._listeners[event])

    def remove_all(self) -> None:
        self._listeners.clear()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The changes published below a shelf's log, as a stream."""
    return spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(path)


def follow(changes: DataFrame, listener: Callable[[dict], None], own_source: str, checkpoint: str):
    """Calls listener with each change of other writers, in order within a batch, until the log's
    present end. Returns the query."""

    def batch(rows: DataFrame, _: int) -> None:
        for row in rows.where(F.col("source") != own_source).orderBy("seq", "sub").toLocalIterator():
            listener({"type": row.type, "id": row.id, "record": row.record.asDict(True) if row.record else None, "remote": True})

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_facets(changes: DataFrame) -> DataFrame:
    """Counts of changes by type and kind, kept up to date (output mode complete)."""
    return changes.groupBy("type", F.col("record.kind").alias("kind")).agg(F.count("*").alias("count"))


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of an event table (ts, event_type) per window; late rows are taken for a while."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("count"))
