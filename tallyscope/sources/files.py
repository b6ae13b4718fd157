"""Files of any store that Spark reaches: listing, renaming, and the first record of each CSV file."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_LINE_END = re.compile(r"\r\n|\r|\n")
#: Lines among which a header must end when Spark's own reader has to find it.
_HEADER_LINES = 64


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str | Sequence[str], deep: bool = True) -> dict[str, int]:
    """Size of each file below a path (or paths) that Spark would read, by name in order."""
    found = {}
    for top in [path] if isinstance(path, str) else path:
        place, system = _system(spark, top)
        files = system.listFiles(place, deep)
        while files.hasNext():
            file = files.next()
            if not file.getPath().getName().startswith(("_", ".")):
                found[file.getPath().toString()] = file.getLen()
    return dict(sorted(found.items()))


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _system(spark, path)
    return system.exists(place)


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Gives a file its final name, in place of an earlier file of that name."""
    place, system = _system(spark, source)
    end = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(end.getParent())
    system.delete(end, False)
    if not system.rename(place, end):
        raise OSError(f"{source} could not be renamed to {target}")


def touched(spark: SparkSession, path: str) -> None:
    """An empty file."""
    place, system = _system(spark, path)
    system.create(place, True).close()


def removed(spark: SparkSession, path: str) -> None:
    place, system = _system(spark, path)
    system.delete(place, True)


def _first_record(stream) -> str:
    """Text up to the first line end outside quotes."""
    data = b""
    while True:
        more = stream.read(1 << 16)
        data += more
        text = data.decode("utf-8", "replace")
        for end in _LINE_END.finditer(text):
            # a line end at the very end may be half of one
            if text.count('"', 0, end.start()) % 2 == 0 and (end.end() < len(text) or not more):
                return text[: end.start()]
        if not more:
            return text


def _opened(path: str):
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(path.removeprefix("file:"), compression="detect")
    store, base = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
    return store.open_input_stream(base.rstrip("/") + path.split(parts.netloc, 1)[1], compression="detect")


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = []
        for path in batch.column(0).to_pylist():
            try:
                with _opened(path) as stream:
                    records.append(_first_record(stream))
            except (OSError, ValueError, ImportError, pa.ArrowException):
                records.append(None)  # a store or packing that only Spark reads
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.string())], names=["file", "record"])


def scanned_records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, record) by Spark's text reader: it reaches every store, and reads the whole files for it."""
    side = spark.newSession()  # one task for each file, so rows are counted from its beginning
    for name in ("maxPartitionBytes", "openCostInBytes"):
        side.conf.set(f"spark.sql.files.{name}", str(1 << 50))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = side.read.text(list(files)).select(path.alias("file"), row.alias("row"), "value").filter(f"row < {_HEADER_LINES}")
    heads = lines.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("lines"))
    upto = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda n: F.array_join(F.slice("lines", F.lit(1), n), "\n"))
    whole = F.filter(upto, lambda t: F.length(F.regexp_replace(t, '[^"]', "")) % 2 == 0)
    return heads.select("file", F.get(whole, F.lit(0)).alias("record"))


def first_records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, record): the first record of each file, opened by the tasks; null where a task cannot open it.

    A record may hold line breaks inside quotes.  Each file is opened once and read to its first record."""
    paths = spark.createDataFrame([(file,) for file in files], "file string")
    return paths.repartition(max(1, min(len(files), 1000))).mapInArrow(_read_records, "file string, record string")


def by_header(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their column names in order; files without a record are left out.

    No file is opened in the driver: it gets one row for each header, with the names of its files."""
    if not files:
        return {}

    def grouped(records: DataFrame) -> dict[str | None, list[str]]:
        rows = records.groupBy("record").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
        return {row.record: row.files for row in rows}

    found = grouped(first_records(spark, files))
    for record, more in grouped(scanned_records(spark, unopened)).items() if (unopened := found.pop(None, None)) else ():
        found[record] = found.get(record, []) + more
    out: dict[tuple[str, ...], list[str]] = {}
    for record, names in found.items():
        header = tuple(next(csv.reader(io.StringIO((record or "").removeprefix("﻿"))), ()))
        if header:
            out[header] = sorted(out.get(header, []) + names)
    return dict(sorted(out.items(), key=lambda item: item[1]))
