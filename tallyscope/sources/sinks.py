"""Sinks: quoted CSV lines, JSON lines, tidy CSV."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.sources.files import listed, removed, renamed


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))


def quoted_lines(df: DataFrame) -> DataFrame:
    """CSV lines: first column an unquoted integer, all other cells quoted, nulls empty.

    The single column is named by the quoted header line.
    """
    first, *rest = df.columns
    cells = [F.col(first).cast("bigint").cast("string")]
    cells += [_quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rest]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    return df.select(F.concat_ws(",", *cells).alias(header))


def export_quoted(df: DataFrame, path: str) -> None:
    """Write ``quoted_lines``; every part file starts with the header line."""
    writer = quoted_lines(df).write.mode("overwrite").option("header", True)
    # the lines are ready: no quoting, and a separator that cannot occur
    writer.option("quote", "").option("escape", "").option("sep", "\u0001").csv(path)


def jsonl_name(description: str, n_events: int, n_pairs: int) -> str:
    return f"{description}--{n_events}-events-by-{n_pairs}-kv-pairs.jsonl"


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def by_folder(df: DataFrame, *columns: str) -> DataFrame:
    """Rows brought together by the columns a table is foldered by.

    A rebalance, not a repartition: a folder with a third of all rows is split over several tasks
    and files, small ones share a task.
    """
    return df.hint("rebalance", *columns)


def write_csv_by(df: DataFrame, path: str, *columns: str) -> None:
    """Header CSV, one folder per value of the given columns."""
    by_folder(df, *columns).write.mode("overwrite").partitionBy(*columns).option("header", True).csv(path)


def size_in_mb(path: str, spark: SparkSession) -> float:
    """Bytes of the files below a path in MB."""
    return sum(listed(spark, path).values()) / (1024 * 1024)


def write_named_csv(df: DataFrame, out_dir: str, name: str = "output", order: Sequence[str] = (), empty: Iterable[str] = ()) -> list[str]:
    """Header CSV files named by the values of the column ``name`` (with their extension), one each.

    In two phases: a Spark job writes all files below a hidden folder, and only when it is done the
    driver gives them their names, each by one rename that replaces an earlier file.  A job that fails
    leaves the names as they were, and a repeated job gives the same files.  Each file is written by one
    task, its rows sorted by the columns ``order``, which are not written; ``empty`` are names that get
    the header alone unless they have rows.  The names are returned."""
    spark = df.sparkSession
    staging = f"{out_dir.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    dealt = df.repartition(name).sortWithinPartitions(name, *order).drop(*order)
    dealt.write.partitionBy(name).option("header", True).csv(f"{staging}/rows")
    parts = {unquote(path.rsplit(f"{name}=", 1)[1].split("/")[0]): path for path in listed(spark, f"{staging}/rows")}
    if missing := sorted(set(empty) - set(parts)):
        heads = spark.createDataFrame([(one,) for one in missing], f"`{name}` string")
        header = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') else c for c in dealt.columns if c != name)
        heads.select(name, F.lit(header).alias("value")).repartition(name).write.partitionBy(name).text(f"{staging}/heads")
        parts |= {unquote(path.rsplit(f"{name}=", 1)[1].split("/")[0]): path for path in listed(spark, f"{staging}/heads")}
    for target, part in parts.items():
        renamed(spark, part, f"{out_dir.rstrip('/')}/{target}")
    removed(spark, staging)
    return sorted(parts)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A catalog table clustered by ``key``.

    Reader KPIs join and group by episode: with the decision, episode, cancer and image tables
    bucketed by ``read_episode_id`` into the same number of buckets, those steps need no shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
