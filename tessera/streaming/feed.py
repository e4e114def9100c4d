"""Triggers as streams, with a lateness limit; streaming.state keeps what is known of each file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fresh_triggers(events: DataFrame, lateness: str = "5 minutes", key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Each trigger once, those older than the watermark left out: works on streams and on tables."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def stale_flags(events: DataFrame, minutes: int = 5, ts: str = "ts") -> DataFrame:
    """Batch form of the lateness rule: stale where a trigger is older than the newest by more than the limit."""
    newest = events.agg(F.max(ts).alias("newest"))
    return events.join(F.broadcast(newest), F.lit(True)).withColumn(
        "stale", F.col(ts) < F.col("newest") - F.expr(f"interval {minutes} minutes")
    ).drop("newest")


def windowed_counts(events: DataFrame, width: str = "10 minutes", lateness: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Triggers by type and window."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("triggers")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "triggers"
    )


def reindex_feed(triggers: DataFrame, reindex: Callable[[list[str] | None], dict], checkpoint: str, listed: int = 1000) -> StreamingQuery:
    """Run an incremental reindex for each batch of fresh triggers that is not empty: of the paths that they name (at most
    `listed`), or of all that has changed where a trigger names none, or there are more."""

    def batch(rows: DataFrame, _: int) -> None:
        if "path" not in rows.columns:
            if not rows.isEmpty():
                reindex(None)
            return
        some = [r.path for r in rows.select("path").distinct().limit(listed + 1).collect()]
        if some:
            reindex(None if None in some or len(some) > listed else sorted(some))

    return triggers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
