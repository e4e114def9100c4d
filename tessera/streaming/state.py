"""Streams with keyed state: what is known of each file or project stays in the state store, one value a key.

The state is in RocksDB below the checkpoint, so a batch costs what it brings: nothing else is read or
written. Rows that the watermark passes are dropped by Spark before they reach a key; timers end what
has been idle. A batch that runs again starts from the state before it and has the same result."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Processors travel as code: the process that starts a stateful operator is given no files of the application.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's setting is restored."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)


class FileChanges(StatefulProcessor):
    """Of each path the last hash and its order; what comes is added, modified or deleted beside that, or nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, seq bigint, deleted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = sorted(((r.seq, r.hash, r.deleted) for r in rows), key=lambda r: r[0])
        was = state = self.last.get() or (None, -1, True)
        for seq, hash_, deleted in seen:
            if seq <= state[1]:  # older than what is known
                continue
            change = ("added" if state[2] else "modified" if hash_ != state[0] else None) if not deleted else (None if state[2] else "deleted")
            state = (None if deleted else hash_, seq, deleted)
            if change:
                yield Row(path=key[0], change=change, hash=state[0], seq=seq)
        if state != was:
            self.last.update(state)

    def close(self) -> None:
        pass


def file_changes(feed: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted), hash and seq: the changes that a feed of (path, hash, deleted, seq) makes.

    seq orders what is said of a path; what comes out of order, twice, or with the hash that is known is no change."""
    rows = feed.select(
        "path", F.col("seq").cast("long").alias("seq"), "hash", F.coalesce("deleted", F.lit(False)).alias("deleted")
    ).where("path is not null and seq is not null")
    return rows.groupBy("path").transformWithState(FileChanges(), "path string, change string, hash string, seq bigint", "Append", "None")


def latest(changes: DataFrame) -> DataFrame:
    """(path, hash) of the files that a table of such changes leaves."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("change", "hash"), "seq").alias("r"))
    return last.where("r.change <> 'deleted'").select("path", "r.hash")


class Sessions(StatefulProcessor):
    """Of each key the triggers accepted so far, the newest of them, and a timer that ends it when it has been idle."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "n bigint, last bigint, at_ms bigint")
        self.recent = handle.getListState("recent", "id bigint, at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The triggers that may repeat are read and written as one list, not one by one."""
        was = self.state.get()
        known = dict(self.recent.get()) if was else {}
        fresh: dict[int, int] = {}
        for r in rows:
            if r.trigger not in known and r.trigger not in fresh:
                fresh[r.trigger] = r.at_ms
        if not fresh:
            return
        n, last, at = was or (0, -1, -1)
        n += len(fresh)
        at, last = max((at, last), max((when, trigger) for trigger, when in fresh.items()))
        self.state.update((n, last, at))
        if was is None or was[2] != at:  # its timer is that of its newest trigger
            if was is not None:
                self.handle.deleteTimer(was[2] + self.idle)
            self.handle.registerTimer(at + self.idle)
        mark = timerValues.getCurrentWatermarkInMs()
        old = [x for x in known.items() if x[1] >= mark]  # Spark drops what could repeat the others
        new = [x for x in fresh.items() if x[1] >= mark]
        if len(old) < len(known):
            self.recent.put(old + new) if old or new else self.recent.clear()
        elif new:
            self.recent.appendList(new)
        yield Row(key=key[0], triggers=n, last=last, at_ms=at, idle=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, last, at = self.state.get()
        self.state.clear()
        self.recent.clear()
        yield Row(key=key[0], triggers=n, last=last, at_ms=at, idle=True)

    def close(self) -> None:
        pass


def trigger_sessions(triggers: DataFrame, lateness: str = "5 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """key, triggers (accepted in this session so far), last (the newest of them), at_ms and idle, for each key that a batch
    changes or that has been idle for so long.

    triggers: key, trigger (an id), ts. One that comes again counts once; one older than the watermark is dropped."""
    rows = triggers.where("key is not null and trigger is not null and ts is not null")
    rows = rows.select("key", "trigger", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    rows = rows.withColumn("at_ms", F.unix_millis("ts"))
    key = triggers.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(
        Sessions(idle_ms), f"key {key}, triggers bigint, last bigint, at_ms bigint, idle boolean", "Append", "EventTime"
    )


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream gives, once each, to a Parquet folder, and stop when nothing new is left."""
    with rocksdb(rows.sparkSession):
        return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
