"""Landing of event streams as JSON-lines data sets, and compaction of small files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyscope.operators.positions import number_rows
from tallyscope.sources.files import exists, listed

# Messages per data set, and the name of a landed data set.
MAX_MESSAGES = 1000
DATASET_PREFIX = "raw-nsp-events"
DATASET_TIME = "yyyy-MM-dd--HH-mm-ss"
NO_TIME = "0000-00-00--00-00-00"
MANIFEST = "batch bigint, attempt string"


def dataset_name(moment: Column, identity: Column, prefix: str = DATASET_PREFIX) -> Column:
    """``<prefix>--<time>--<uuid>`` with the uuid made from ``identity``; zeros without a time.

    Both come from the data, so landing the same batch again gives the same names.
    """
    digest = F.md5(identity)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    uuid = F.concat_ws("-", *[F.substring(digest, at, size) for at, size in parts])
    stamp = F.coalesce(F.date_format(moment, DATASET_TIME), F.lit(NO_TIME))
    return F.concat_ws("--", F.lit(prefix), stamp, uuid)


def in_datasets(batch: DataFrame, batch_id: int, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """The batch with a ``dataset`` column: at most ``max_messages`` events to a data set, by id.

    The rows of a data set lie in one partition."""
    numbered = number_rows(batch, [F.col("id"), F.col("timestamp")], name="_no")
    chunked = numbered.withColumn("_chunk", F.expr(f"_no div {max_messages}")).drop("_no")
    # a chunk is bounded, so its newest moment comes from a window, and the rows move once
    newest = F.max(F.col("timestamp").try_cast("timestamp_ntz")).over(W.partitionBy("_chunk"))
    name = dataset_name(newest, F.concat_ws("/", F.lit(str(batch_id)), F.col("_chunk").cast("string")))
    return chunked.withColumn("dataset", name).drop("_chunk")


def land_events(
    stream: DataFrame, out: str, checkpoint: str, max_messages: int = MAX_MESSAGES,
    after: Callable[[str, int], None] | None = None,
) -> StreamingQuery:
    """Write the stream as JSON-lines data sets until it is drained; ``read_landed`` reads them.

    Each attempt at a micro-batch writes its data sets, each by one task, below a folder of its own and
    then a manifest of one row that names the folder.  Manifests are added, never changed.  A writer
    that stops before its manifest, or a second one at the same batch, is therefore never seen: a reader
    takes one attempt of each batch, and all attempts of a batch hold the same events.  The source
    offsets are committed after the manifest, so a stop in between replays the batch.

    ``after(step, batch)`` is called when the data sets (``written``) and the manifest (``named``) of a
    batch are there; an error raised in it stops the query at that place.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        named = in_datasets(batch, batch_id, max_messages)
        named.write.partitionBy("dataset").json(f"{out}/data/{attempt}")
        if after:
            after("written", batch_id)
        manifest = batch.sparkSession.createDataFrame([(batch_id, attempt)], MANIFEST)
        manifest.coalesce(1).write.json(f"{out}/manifest/{attempt}")
        if after:
            after("named", batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def committed(spark: SparkSession, out: str) -> list[str]:
    """The data folders that count: of each batch the attempt that comes first by name."""
    if not exists(spark, f"{out}/manifest"):
        return []
    manifests = spark.read.schema(MANIFEST).json(f"{out}/manifest/*")
    chosen = manifests.groupBy("batch").agg(F.min("attempt").alias("attempt")).orderBy("batch")
    return [f"{out}/data/{row.attempt}" for row in chosen.collect()]


def read_landed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """Rows of all committed data sets, with their name as ``dataset``."""
    schema = f"{schema}, dataset string"
    folders = committed(spark, out)
    if not folders:
        return spark.createDataFrame([], schema)
    # data set folders are columns; the folders of attempts are not
    rows = spark.read.schema(schema.rsplit(",", 1)[0]).option("recursiveFileLookup", True).json(folders)
    name = F.regexp_extract(F.col("_metadata.file_path"), "/dataset=([^/]+)/[^/]*$", 1)
    return rows.withColumn("dataset", F.url_decode(name))


def compact(spark: SparkSession, source: str, target: str, target_mb: float = 128.0) -> int:
    """Rewrite a folder of many small text files (JSON lines, say) as files of about ``target_mb``.

    Small files are packed into read splits of that size, and larger ones cut at lines, by the scan
    itself: each split is written by the task that reads it, without a shuffle.  Lines stay as they
    are.  Returns the number of files written.
    """
    packed = spark.newSession()  # the sizes hold for this scan only
    for name, value in {"maxPartitionBytes": max(1, int(target_mb * 1024 * 1024)), "openCostInBytes": 0, "minPartitionNum": 1}.items():
        packed.conf.set(f"spark.sql.files.{name}", str(value))
    packed.read.option("recursiveFileLookup", True).text(source).write.mode("overwrite").text(target)
    return len(listed(spark, target))
