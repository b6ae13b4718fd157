"""Event tables: nested payloads of one-key maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Explicit, because inference would turn the maps into one wide struct.
EVENT_SCHEMA = "id bigint, name string, timestamp string, payload array<map<string,string>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of events, with the declared schema."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def unnest_payload(events: DataFrame) -> DataFrame:
    """One row per payload entry: event columns, place in the payload, key, value."""
    entries = events.select("id", "name", "timestamp", F.posexplode("payload").alias("pair_no", "_pair"))
    flat = entries.select("id", "name", "timestamp", F.col("pair_no").cast("bigint").alias("pair_no"), F.explode("_pair"))
    return flat
