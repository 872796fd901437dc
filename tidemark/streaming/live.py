"""Live queries and event-time windows over streams of files.

Each function takes a streaming or a batch DataFrame: the plan is the same, so the batch form is what tests hold a
stream against.
"""

from __future__ import annotations

import queue
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 8) -> DataFrame:
    """Parquet files as they arrive; back-pressure is the number of files taken at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def event_time(events: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """With a zoned event time to window by, late beyond ``delay`` on a stream."""
    return events.withColumn("event_time", F.col(column).cast("timestamp")).withWatermark("event_time", delay)


def tumbling(events: DataFrame, width: str, *keys: str, **measures: Column) -> DataFrame:
    return _windowed(events, F.window("event_time", width), keys, measures)


def sliding(events: DataFrame, width: str, step: str, *keys: str, **measures: Column) -> DataFrame:
    return _windowed(events, F.window("event_time", width, step), keys, measures)


def sessions(events: DataFrame, gap: str, *keys: str, **measures: Column) -> DataFrame:
    """Runs of events of a key with less than ``gap`` between them."""
    return _windowed(events, F.session_window("event_time", gap), keys, measures)


def _windowed(events: DataFrame, window: Column, keys: tuple[str, ...], measures: dict[str, Column]) -> DataFrame:
    grouped = events.groupBy(window.alias("w_"), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    at = lambda side: F.col(f"w_.{side}").cast("timestamp_ntz").alias(f"window_{side}")
    return grouped.select(at("start"), at("end"), *keys, *measures)


def first_of_each(events: DataFrame, *keys: str) -> DataFrame:
    """Without repeats of a key within the watermark (on a stream)."""
    return events.dropDuplicatesWithinWatermark([*keys]) if events.isStreaming else events.dropDuplicates([*keys])


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop, writing Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def live_query(source: DataFrame, query: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """The whole answer of an aggregation each time its source grows, until what has arrived is taken in."""
    stream = query(source).writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def after_change(source: DataFrame, trigger: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """An AFTER trigger: a function of each batch of new rows."""
    source.writeStream.foreachBatch(trigger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Subscriber:
    """Answers of a live query that wait for a reader, at most ``room`` of them.

    ``post`` has the form of a ``publish`` function's last step: it takes what names an answer (a version, a path), not its
    rows.  When there is no room, ``drop`` leaves the new answer out, ``evict`` the oldest waiting one, and ``block`` waits for
    ``patience`` seconds and then ends the subscription.
    """

    def __init__(self, room: int, policy: str = "drop", patience: float = 5.0) -> None:
        if policy not in ("drop", "block", "evict"):
            raise ValueError(policy)
        self.policy, self.patience, self.open = policy, patience, True
        self.waiting: queue.Queue = queue.Queue(room)

    def post(self, answer: object) -> bool:
        """Whether the subscription goes on."""
        if not self.open:
            return False
        try:
            self.waiting.put(answer, block=self.policy == "block", timeout=self.patience)
        except queue.Full:
            if self.policy == "block":
                self.open = False
            elif self.policy == "evict":
                self._replace_oldest(answer)
        return self.open

    def _replace_oldest(self, answer: object) -> None:
        try:
            self.waiting.get_nowait()
        except queue.Empty:  # a reader was faster
            pass
        self.waiting.put_nowait(answer)

    def take(self) -> object | None:
        """The oldest waiting answer, None if there is none."""
        try:
            return self.waiting.get_nowait()
        except queue.Empty:
            return None
