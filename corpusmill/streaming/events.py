"""Structured Streaming: incremental ingest, windowed metrics and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, TimestampNTZType

from corpusmill.operators.incremental import refresh
from corpusmill.operators.upsert import classify
from corpusmill.sources.store import CODEC, Store
from corpusmill.sources.tables import materialise


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files under ``path`` as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_instants(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event times as instants; times without a zone are taken as UTC."""
    if isinstance(events.schema[ts].dataType, TimestampNTZType):
        return events.withColumn(ts, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`))"))
    return events


def windowed_metrics(events: DataFrame, width: str = "1 hour", late: str = "1 hour", name: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """count, sum, min and max of each name in each tumbling window; rows later than ``late`` are dropped."""
    keyed = with_instants(events, ts).withWatermark(ts, late).groupBy(F.window(ts, width), F.col(name).alias("name"))
    return keyed.agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")).select("window.start", "window.end", "name", "count", "sum", "min", "max")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Each user's sessions, which end after ``gap`` without an event: start, end, user_id, events."""
    keyed = with_instants(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(user).alias("user_id"))
    return keyed.agg(F.count(F.lit(1)).alias("events")).select("w.start", "w.end", "user_id", "events")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each key once, as long as its repetition isn't later than ``late``."""
    return with_instants(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there and return the result as a table under ``path``.

    append adds each batch's rows; complete keeps the last batch's whole result.
    """
    spark, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(schema).parquet(path)
    last: list[str] = []

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last[:] = [f"{path}/batch-{number}"]

    writer.foreachBatch(batch).start().awaitTermination()
    return spark.read.schema(schema).parquet(*last) if last else spark.createDataFrame([], schema)


def ingest(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], store: Store, collection: str, checkpoint: str, order: str, compare: tuple[str, ...] = ("text",), indexed: bool = False) -> StreamingQuery:
    """Upsert each batch of the stream, as ``prepare`` turns it into chunks, into a collection of ``store``.

    With ``indexed`` what derives from the collection is kept up as well (``incremental.refresh``). A batch reads and writes only the
    buckets that hold something of it. Derived tables are written before the collection, and take away all
    that a changed chunk may have had there, so that a batch that is run again after a failure comes to the same.
    """

    def batch(rows: DataFrame, number: int) -> None:
        chunks = materialise(prepare(rows), "chunks", CODEC)
        if not store.exists(collection):
            store.write(collection, chunks.limit(0))
        now = store.get(collection, chunks)
        changes = materialise(classify(chunks, now, order, compare), "changes", CODEC)
        changed = changes.where("action <> 'same'").select(*now.columns)
        if indexed:
            old = materialise(now.join(changed.select("id"), "id", "left_semi").select(*now.columns), "old")
            refresh(store, collection, old, changed)
        store.put(collection, changed, placed=True)  # a written table, so that its tasks are few

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
