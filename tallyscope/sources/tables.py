"""Scans: supplied Parquet tables, CSV folders, JSON documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyscope.sources.files import by_header, listed


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class LazyTables(Mapping):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


_TEXT, _TIME = T.StringType(), T.TimestampNTZType()

# Declared schemas of the image-reading CSV tables; the file stem is the table name.
READING_SCHEMAS: dict[str, T.StructType] = {
    "Participant": T.StructType(
        _fields("participant_id", _TEXT)
        + _fields("date_of_birth", T.DateType())
        + _fields("ethnic_background_id risk_level nhs_number", _TEXT)
    ),
    "ScreeningEpisode": T.StructType(_fields("screening_episode_id participant_id", _TEXT)),
    "Appointment": T.StructType(_fields("appointment_id screening_episode_id", _TEXT)),
    "Image": T.StructType(_fields("image_id appointment_id participant_id read_episode_id", _TEXT)),
    "Reader": T.StructType(_fields("reader_id bso_code", _TEXT)),
    "ReadEpisode": T.StructType(
        _fields("read_episode_id first_reader_id", _TEXT)
        + _fields("first_reader_started_at first_reader_ended_at", _TIME)
        + _fields("second_reader_id", _TEXT)
        + _fields("second_reader_started_at second_reader_ended_at", _TIME)
        + _fields("arbitrator_reader_id", _TEXT)
    ),
    "CancerPresence": T.StructType(_fields("cancer_presence_id read_episode_id cancer_present", _TEXT)),
    "Biopsies": T.StructType(_fields("biopsy_id read_episode_id biopsy_result", _TEXT)),
    "IntervalCancers": T.StructType(_fields("interval_cancer_id participant_id interval_cancer_found", _TEXT)),
    "ReadDecision": T.StructType(
        _fields("read_decision_id read_episode_id reader_id reader_decision decision_type", _TEXT)
    ),
    "ReadHistory": T.StructType(
        _fields("read_decision_hist_id read_decision_id reader_id reader_decision decision_type", _TEXT)
        + _fields("decision_timestamp", _TIME)
    ),
    "ReadOutcome": T.StructType(
        _fields("read_outcome_id read_episode_id read_outcome", _TEXT) + _fields("read_outcome_date", _TIME)
    ),
    "ArbitrationDecision": T.StructType(
        _fields("arbitration_id read_decision_id arbitrator_reader_id arbitration_format", _TEXT)
        + _fields("arbitration_date", _TIME)
        + _fields("arbitration_decision", _TEXT)
    ),
}


def csv_parts(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files below a path (or paths) that Spark would read, sorted."""
    return list(listed(spark, path))


def _reader(spark: SparkSession, null_value: str | None, multi_line: bool, base: str | None):
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.option("basePath", base) if base else reader


def _base(path: str | Sequence[str]) -> str | None:
    """Folder from which ``name=value`` folders become columns, when a single folder is read."""
    return path if isinstance(path, str) and not path.lower().endswith(".csv") else None


def csv_table(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, null_value: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with headers, read by declared column names: files of one folder may order columns differently.

    With ``multi_line`` cells may hold line breaks, and a file is then read by one task."""
    declared = {field.name: field.dataType for field in schema}
    parts = []
    for header, files in by_header(spark, csv_parts(spark, path)).items():
        missing = [name for name in declared if name not in header]
        if missing:
            raise ValueError(f"{files[0]}: missing columns {missing}")
        as_read = T.StructType([T.StructField(name, declared.get(name, _TEXT)) for name in header])
        parts.append(_reader(spark, null_value, multi_line, None).schema(as_read).csv(files).select(*declared))
    if not parts:
        raise ValueError(f"no CSV with a header at {path}")
    return reduce(DataFrame.unionByName, parts)


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files directly in a folder, sorted by name."""
    return [path for path in listed(spark, folder, deep=False) if path.lower().endswith(".csv")]


def reading_tables(
    spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType] = READING_SCHEMAS
) -> LazyTables:
    """The tables of a folder by file stem: declared columns for known names, all text for others."""

    def builder(path: str, stem: str):
        if stem in schemas:
            return lambda: csv_table(spark, path, schemas[stem])
        return lambda: text_csv(spark, path)

    stems = {path.rsplit("/", 1)[-1][: -len(".csv")]: path for path in csv_files(spark, folder)}
    return LazyTables({stem: builder(path, stem) for stem, path in stems.items()})


def text_csv(
    spark: SparkSession, path: str | Sequence[str], null_value: str | None = None, multi_line: bool = False, with_file: bool = False
) -> DataFrame:
    """CSV with every column as text, as written in the file ('007' and '1' stay as they are).

    Files are matched by column name: those with the same header are read together, and a column that
    a file lacks is null in its rows.  ``multi_line`` allows line breaks inside quoted cells (a file is
    then read by one task); ``with_file`` adds the decoded name of each row's file as ``file_name``."""
    groups = by_header(spark, csv_parts(spark, path))
    parts = [_text_part(spark, header, files, null_value, multi_line, _base(path), with_file) for header, files in groups.items()]
    if not parts:
        raise ValueError(f"no CSV with a header at {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _text_part(
    spark: SparkSession, header: Sequence[str], files: list[str], null_value: str | None = None, multi_line: bool = False,
    base: str | None = None, with_file: bool = False,
) -> DataFrame:
    schema = T.StructType([T.StructField(name, _TEXT) for name in header])
    part = _reader(spark, null_value, multi_line, base).schema(schema).csv(files)
    return part.withColumn("file_name", decoded_name()) if with_file else part


def text_csv_groups(spark: SparkSession, files: list[str], multi_line: bool = False) -> list[tuple[DataFrame, list[str]]]:
    """The rows of the files as text with ``file_name``, one table for each header, and the table's files."""
    return [(_text_part(spark, header, some, multi_line=multi_line, with_file=True), some) for header, some in by_header(spark, files).items()]


def decoded_name() -> Column:
    """Name of the file a row was read from, as it is on disk."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def json_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per non-empty JSON file: ``file_name``, ``json``."""
    return (
        spark.read.text(path, wholetext=True)
        .filter(F.col("_metadata.file_size") > 0)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("json"))
    )


def checked_documents(documents: DataFrame, schema: str, text: str = "json") -> DataFrame:
    """The documents with ``parsed`` by the schema, and ``corrupt``: the text of those that are no JSON
    object of this schema, whose ``parsed`` is null.  A broken response is then told from an empty one,
    and ``corrupt IS NOT NULL`` counts them.  A null text is neither."""
    kept = T._parse_datatype_string(schema).add("_corrupt", _TEXT)
    read = F.from_json(text, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # text that is white space only parses to null
    corrupt = F.coalesce(F.col("_read._corrupt"), F.when(F.col("_read").isNull(), F.col(text)))
    fields = [F.col(f"_read.{field.name}").alias(field.name) for field in kept if field.name != "_corrupt"]
    return documents.withColumn("_read", read).withColumns({"corrupt": corrupt, "parsed": F.when(corrupt.isNull() & F.col(text).isNotNull(), F.struct(*fields))}).drop("_read")


def missing_and_extra(df: DataFrame, template: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns the template has and the table lacks, and the reverse."""
    return sorted(set(template) - set(df.columns)), sorted(set(df.columns) - set(template))


def check_header(df: DataFrame, template: Sequence[str]) -> DataFrame:
    """The table itself if its columns equal the template's as a set; an error naming the rest."""
    missing, extra = missing_and_extra(df, template)
    if missing or extra:
        raise ValueError(f"columns differ from the template: missing {missing}, extra {extra}")
    return df


def flat_file_name(path: Column, suffix: str = "_flat") -> Column:
    """Default output name: the suffix goes before the extension."""
    return F.when(
        path.rlike(r"[^/.][^/]*\.[^/.]*$"), F.regexp_replace(path, r"(\.[^/.]*)$", f"{suffix}$1")
    ).otherwise(F.concat(path, F.lit(suffix)))
