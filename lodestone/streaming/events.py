"""The event log as a stream: each event once, written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def once(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events once per id; state is kept for as long as an event may come again."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events and value sums of each window and type; an extension of the log, closed windows only."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def append(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write each batch to a folder of its own number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remember(events: DataFrame, name: str) -> StreamingQuery:
    """Keep events in a table of the driver's memory; for tests and short looks only."""
    return events.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()


def ingest(events: DataFrame, store, checkpoint: str) -> StreamingQuery:
    """Hand each batch to an experiment store, which checks the runs' life cycles and takes an event only once.

    A batch that is run again changes nothing; one that breaks a run's life
    stops the stream.
    """

    def take(batch: DataFrame, _: int) -> None:
        store.ingest(batch)

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
