"""Reporting periods (April to March) taken from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.sources.sinks import write_named_csv
from tallyscope.sources.tables import csv_files, text_csv_groups

# Fixed value: the stem of a file name ends in the year the period ends in.
YEAR_SUFFIX = r"(\d{4})$"


def file_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def year_or_null(path: Column) -> Column:
    return F.nullif(F.regexp_extract(file_stem(path), YEAR_SUFFIX, 1), F.lit("")).cast("int")


def year_from_filename(path: Column) -> Column:
    """Last four digits at the end of the stem; an error where they are absent."""
    problem = F.concat(F.lit("Filename '"), path, F.lit("' does not end with a 4-digit year"))
    return F.coalesce(year_or_null(path), F.raise_error(problem).cast("int"))


def reporting_period(year: Column) -> Column:
    return F.concat_ws("-", (year - 1).cast("string"), year.cast("string"))


def with_reporting_period(df: DataFrame, path: str = "source_file") -> DataFrame:
    return df.withColumn("reporting_period", reporting_period(year_from_filename(F.col(path))))


def tag_reporting_period(spark: SparkSession, in_dir: str, out_dir: str, multi_line: bool = False, single_files: bool = False) -> DataFrame:
    """Every CSV of a folder with a constant ``reporting_period`` column, as all-text CSV.

    The output has one folder per input, ``output=<stem>_preprocessed``, so that large files stay
    split; with ``single_files`` it is one file per input, ``<stem>_preprocessed.csv``, with the rows in
    the input's order and the header alone for an input without rows.  Files with the same header are
    read and written together.  The tagged rows of the inputs are returned as well, with ``output``
    telling the files apart.
    """
    groups = text_csv_groups(spark, csv_files(spark, in_dir), multi_line)
    if not groups:
        raise ValueError(f"no CSV files in {in_dir}")
    tagged = None
    for rows, files in groups:
        output = F.concat(file_stem(F.col("file_name")), F.lit("_preprocessed"))
        if single_files:
            # a split's rows follow each other in their task
            placed = rows.withColumns({"_start": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
            part = with_reporting_period(placed, "file_name").withColumn("output", F.concat(output, F.lit(".csv"))).drop("file_name")
            names = [f"{path.rsplit('/', 1)[1].rsplit('.', 1)[0]}_preprocessed.csv" for path in files]
            write_named_csv(part, out_dir, "output", ["_start", "_row"], names)
            part = part.drop("_start", "_row")
        else:
            part = with_reporting_period(rows, "file_name").withColumn("output", output).drop("file_name")
            # one write per header group keeps each output's own columns; a rerun replaces its outputs
            writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("output").option("header", True).csv(out_dir)
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return tagged
