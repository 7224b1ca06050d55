"""Experiment event log: identity, order, life cycle and projections, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_hash(events: DataFrame, columns: list[str]) -> DataFrame:
    """Events with the digest of their envelope: sorted keys as JSON."""
    return events.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def deduplicate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events once per id, and ids that came with different contents; one shuffle by id for both."""
    grouped = events.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), "content_hash").alias("e"), F.min("content_hash").alias("lo"), F.max("content_hash").alias("hi"), F.count("*").alias("deliveries"))
    once = grouped.filter("lo = hi").select("event_id", "e.*", "deliveries")
    return once, grouped.filter("lo <> hi").select("event_id", "deliveries")


def sequence(events: DataFrame, run: str, *order: str) -> DataFrame:
    """Gap-free sequence within each run."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def lifecycle(events: DataFrame, run: str, start: str, finish: str, failed: str) -> DataFrame:
    """One row per run: its state and whether events break the order start, questions, finish.

    ``events`` has ``sequence, event_type``.  A run is ``unregistered`` without
    a start, ``failed`` from its first failure, ``completed`` from its finish,
    else ``running``.
    """
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("sequence")))
    rows = events.groupBy(run).agg(at(start).alias("started"), at(finish).alias("finished"), at(failed).alias("failed"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n_events"))
    late = (F.col("finished") < F.col("last")) | (F.col("failed") < F.col("last")) | (F.col("started") > F.col("first"))
    state = F.when(F.col("started").isNull(), "unregistered").when(F.col("failed").isNotNull() & F.coalesce(F.col("failed") < F.col("finished"), F.lit(True)), "failed").when(F.col("finished").isNotNull(), "completed").otherwise("running")
    return rows.select(run, state.alias("state"), F.coalesce(late, F.lit(False)).alias("out_of_order"), "n_events")


def projection(events: DataFrame, run: str) -> DataFrame:
    """Counters and latencies of each run, recomputed from its events."""
    return events.groupBy(run).agg(F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_types"), F.avg("value").alias("mean_value"), F.percentile("value", 0.95).alias("p95_value"))


def resume(planned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that has no stored result yet."""
    return planned.join(stored.select(*keys).distinct(), keys, "left_anti")
