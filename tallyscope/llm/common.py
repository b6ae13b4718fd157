"""What the corpus operators share: table reading, staged tables and Arrow text access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.session import fresh_path

#: The white space of the word rules, as a character class body: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: Bits of a bitmap that Spark builds.
_BLOCK = 1 << 15


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: they survive a lost executor and
    are not computed again by each reader."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Empties the folders of staged tables that nothing reads any more."""
    for table_ in tables:
        for folder in {path.rsplit("/", 1)[0] for path in table_.inputFiles()}:
            table_.sparkSession.createDataFrame([], table_.schema).write.mode("overwrite").parquet(folder)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it does on a JVM collection."""
    spark.sparkContext._jvm.System.gc()


def narrowed(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key occurs among the wanted ones, and a few others, without moving any row: a join may
    follow, and then moves these alone.

    Tasks get a bitmap of the wanted keys' hashes, 32 bits to a key and at most 32 MB; with more than
    8 million wanted rows more of the others stay.  Null is a key like any other."""
    bits = min(max(32 * wanted.count(), _BLOCK), 1 << 28)
    place = F.pmod(F.xxhash64(wanted_key), F.lit(bits))
    blocks = wanted.select(place.alias("place")).groupBy(F.expr(f"place div {_BLOCK}").alias("block")).agg(F.expr(f"bitmap_construct_agg(place % {_BLOCK})").alias("bitmap"))
    at = F.pmod(F.xxhash64(rows[key]), F.lit(bits))
    byte = F.substring(blocks["bitmap"], (F.floor(at % _BLOCK / 8) + 1).cast("int"), F.lit(1))
    there = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (at % 8).cast("int")) == 1
    return rows.join(F.broadcast(blocks), (F.floor(at / _BLOCK) == blocks["block"]) & there, "left_semi")


def held_out(id_col: str, folds: int) -> Column:
    """Whether the checksum of the id as text falls into fold 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds one row or at most about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the n + 1 offsets of its rows; null is empty."""
    texts = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
