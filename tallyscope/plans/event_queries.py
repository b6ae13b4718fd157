"""Event queries: the supplied events as nested event tables."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyscope.operators import events as ev
from tallyscope.session import fresh_path
from tallyscope.sources.files import listed
from tallyscope.sources.sinks import write_jsonl
from tallyscope.sources.tables import parquet_table
from tallyscope.streaming.landing import compact, land_events, read_landed

_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _as_events(df):
    return df.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("name"),
        F.date_format("ts", _STAMP).alias("timestamp"),
        F.array(F.from_json("props", "map<string,string>")).alias("payload"),
    )


def events(spark, folder):
    return _as_events(parquet_table(spark, folder, "events"))


def _round_trip(spark, folder):
    path = fresh_path(spark, "events")
    write_jsonl(events(spark, folder), path)
    return ev.unnest_payload(ev.read_events(spark, path))


def _stream(spark, folder, batches=1):
    """The supplied events as a stream of files, some for each micro-batch: all cores write them and read a batch."""
    supplied = parquet_table(spark, folder, "events")
    path = fresh_path(spark, "arriving")
    supplied.repartition(batches * spark.sparkContext.defaultParallelism, "event_id").write.parquet(path)
    stream = spark.readStream.schema(supplied.schema)
    if batches > 1:  # otherwise all files are one micro-batch
        stream = stream.option("maxFilesPerTrigger", max(1, -(-len(listed(spark, path)) // batches)))
    return _as_events(stream.parquet(path))


def _landed(spark, folder):
    out = fresh_path(spark, "landed")
    land_events(_stream(spark, folder), out, fresh_path(spark, "offsets")).awaitTermination()
    return ev.unnest_payload(read_landed(spark, out, ev.EVENT_SCHEMA))


def _landed_sizes(spark, folder):
    """How many data sets hold how many events."""
    out = fresh_path(spark, "landed")
    land_events(_stream(spark, folder), out, fresh_path(spark, "offsets")).awaitTermination()
    sizes = read_landed(spark, out, ev.EVENT_SCHEMA).groupBy("dataset").agg(F.count(F.lit(1)).alias("events"))
    return sizes.groupBy("events").agg(F.count(F.lit(1)).alias("datasets"))


def land_restarted(spark, stream, out, stops):
    """Lands a stream that stops at each (step, batch) of ``stops`` once, and is started again."""
    offsets, left = fresh_path(spark, "offsets"), set(stops)

    def stop(step, batch):
        if (step, batch) in left:
            left.discard((step, batch))
            raise RuntimeError(f"stopped when {step}")

    while True:
        try:
            land_events(stream, out, offsets, after=stop).awaitTermination()
            return
        except StreamingQueryException as error:
            if "stopped when" not in str(error):
                raise


def _landed_restarted(spark, folder):
    """Events in eight batches; those that stop before and behind their manifest are replayed, and a
    folder that no manifest names is not read."""
    out = fresh_path(spark, "landed")
    write_jsonl(events(spark, folder).limit(5), f"{out}/data/3-unnamed/dataset=unfinished")
    land_restarted(spark, _stream(spark, folder, 8), out, [("written", 2), ("named", 4), ("written", 4)])
    return ev.unnest_payload(read_landed(spark, out, ev.EVENT_SCHEMA))


def _compacted(spark, folder):
    small, large = fresh_path(spark, "small"), fresh_path(spark, "compacted")
    write_jsonl(events(spark, folder).repartition(40), small)
    compact(spark, small, large)
    return ev.unnest_payload(ev.read_events(spark, large))


QUERIES = {
    "event_table": lambda s, d: events(s, d).select("id", "name", "timestamp", F.to_json("payload").alias("payload")),
    "event_unnested": lambda s, d: ev.unnest_payload(events(s, d)),
    "event_json_lines": _round_trip,
    "event_landed": _landed,
    "event_landed_sizes": _landed_sizes,
    "event_landed_restarted": _landed_restarted,
    "event_compacted": _compacted,
}

_UNNESTED = """SELECT event_id AS id, event_type AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 0::bigint AS pair_no,
  'k' AS key, json_extract_string(props, '$.k') AS value FROM events"""

ORACLE = {
    "event_table": """SELECT event_id AS id, event_type AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
      '[{"k":"' || json_extract_string(props, '$.k') || '"}]' AS payload FROM events""",
    "event_unnested": _UNNESTED,
    "event_json_lines": _UNNESTED,
    "event_landed": _UNNESTED,
    "event_landed_restarted": _UNNESTED,
    "event_landed_sizes": """SELECT events, count(*) AS datasets FROM (SELECT count(*) AS events FROM (
      SELECT (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS chunk FROM events) GROUP BY chunk) GROUP BY 1""",
    "event_compacted": _UNNESTED,
}
