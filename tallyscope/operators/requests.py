"""Planning and reporting of census requests: validation, batches, parameters, outcomes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.operators.positions import number_rows
from tallyscope.sources.tables import text_csv

# Levels, batch sizes, levels fetched through filters, defaults.
LEVELS = ("ctry", "rgn", "la", "msoa", "lsoa", "oa")
LEVEL_BATCH_SIZE = 200
OTHER_BATCH_SIZE = 50
FILTER_BATCH_SIZE = 5000
LARGE_LEVELS = ("lsoa", "msoa", "oa")
EDITION, VERSION, POPULATION = "2021", 1, "UR"

# Message texts (%s: data set, level, prefix or status, in reading order).
NO_DATASET = "Dataset ID is required"
SHORT_DATASET = "Invalid dataset ID format: %s"
UNSUPPORTED_TYPE = "Unsupported dataset type: %s"
INVALID_LEVEL = "Invalid geographic level: %s"
NO_AREAS = "No areas found for geographic level: %s"
NOT_FOUND = "Dataset %s not found at %s level (404)"
HTTP_ERROR = "HTTP error %s checking dataset %s at %s level"
REQUEST_ERROR = "Error requesting dataset: %s"
NO_OBSERVATIONS = "Dataset %s doesn't contain observations at %s level"
NOT_AVAILABLE = "Dataset not available at this level"
HINT_LEVELS = "This dataset may not be available at the requested geographic levels."
HINT_OA = "Output Area (OA) level data is not available for all datasets."


def batch_size(level: Column, override: Column | None = None) -> Column:
    """Areas per request: 200 for the known levels, 50 for others; an override replaces the former."""
    known = F.lit(LEVEL_BATCH_SIZE) if override is None else F.coalesce(F.nullif(override, F.lit(0)), F.lit(LEVEL_BATCH_SIZE))
    return F.when(level.isin(*LEVELS), known).otherwise(F.lit(OTHER_BATCH_SIZE)).cast("bigint")


def number_areas(areas: DataFrame, order: str = "area_code") -> DataFrame:
    """``area_no`` from 0 within each level."""
    return number_rows(areas, [F.col(order)], ["geo_level"], "area_no")


def area_batches(numbered: DataFrame, size: int | Column) -> DataFrame:
    """One row per batch of at most ``size`` areas, codes in order (a list is as long as a batch)."""
    size = F.lit(size) if isinstance(size, int) else size
    batch = F.call_function("div", F.col("area_no"), size.cast("bigint"))
    grouped = numbered.withColumn("batch_no", batch + 1).groupBy("geo_level", "batch_no")
    codes = F.array_sort(F.collect_list(F.struct("area_no", "area_code")))
    return grouped.agg(codes.alias("_codes")).select(
        "geo_level", "batch_no", F.col("_codes.area_code").alias("area_codes")
    )


def area_param(level: Column, codes: Column) -> Column:
    """``level,code1,code2,...``"""
    return F.concat_ws(",", level, codes)


def request_url(base: str, dataset_id: Column, param: Column) -> Column:
    path = F.concat(F.lit(f"{base}/datasets/"), dataset_id, F.lit(f"/editions/{EDITION}/versions/{VERSION}/json"))
    return F.concat(path, F.lit("?area-type="), param)


def filter_payload(
    dataset_id: Column, level: Column, codes: Column, extra: Column, population: Column | None = None,
    edition: str = EDITION, version: int = VERSION,
) -> Column:
    """JSON body of a filter request.

    The geographic dimension is there when a level and codes are; ``extra`` is an array of names, or
    of whole dimension objects as JSON text.
    """
    head = F.struct(
        dataset_id.alias("id"), F.lit(edition).alias("edition"), F.lit(version).alias("version")
    )
    area = F.to_json(F.struct(level.alias("name"), F.lit(True).alias("is_area_type"), codes.alias("options")))
    has_area = (F.coalesce(level, F.lit("")) != "") & (F.coalesce(F.size(codes), F.lit(0)) > 0)
    names = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda n: F.when(n.startswith("{"), n).otherwise(F.to_json(F.struct(n.alias("name")))))
    dims = F.concat_ws(",", F.when(has_area, area), names)
    population = F.lit(POPULATION) if population is None else F.coalesce(population, F.lit(POPULATION))
    kind = F.to_json(F.struct(population.alias("population_type")))
    return F.concat(
        F.lit('{"dataset":'), F.to_json(head), F.lit(","), F.substring(kind, F.lit(2), F.length(kind) - 2),
        F.lit(',"dimensions":['), dims, F.lit("]}"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """``reason``: null for a valid request, otherwise the first problem."""
    dataset, level = F.col("dataset_id"), F.col("geo_level")
    prefix = F.upper(F.substring(dataset, 1, 2))
    reason = (
        F.when(F.coalesce(dataset, F.lit("")) == "", NO_DATASET)
        .when(F.length(dataset) < 3, F.format_string(SHORT_DATASET, dataset))
        .when(~prefix.isin("TS", "RM"), F.format_string(UNSUPPORTED_TYPE, prefix))
        .when((F.coalesce(level, F.lit("")) != "") & ~level.isin(*LEVELS), F.format_string(INVALID_LEVEL, level))
    )
    return requests.withColumn("reason", reason)


def expand_requests(requests: DataFrame) -> DataFrame:
    """One row per level (all six without one), output folder and batch size filled in."""
    wanted = F.when(F.coalesce("geo_level", F.lit("")) == "", F.array(*[F.lit(l) for l in LEVELS])).otherwise(
        F.array("geo_level")
    )
    folder = F.coalesce(F.nullif("output_dir", F.lit("")), F.concat(F.lit("data/"), F.col("dataset_id")))
    expanded = requests.withColumn("output_dir", folder).withColumn("geo_level", F.explode(wanted))
    return expanded.withColumn("batch_size", batch_size(F.col("geo_level"), F.col("batch_size")))


def route(level: Column, use_filter: Column) -> Column:
    large = F.coalesce(level.isin(*LARGE_LEVELS), F.lit(False))
    return F.when(F.coalesce(use_filter, F.lit(False)) | large, "filter").otherwise("batch")


def availability(responses: DataFrame) -> DataFrame:
    """``is_available`` and the message otherwise, from (n_areas, status, n_observations).

    ``status`` is the HTTP status of the test request; a request that failed without one has its
    failure in a column ``failure``, where there is such a column.
    """
    dataset, level, status = F.col("dataset_id"), F.col("geo_level"), F.col("status")
    failure = F.col("failure") if "failure" in responses.columns else F.lit(None).cast("string")
    message = (
        F.when(F.coalesce("n_areas", F.lit(0)) == 0, F.format_string(NO_AREAS, level))
        .when(status == 404, F.format_string(NOT_FOUND, dataset, level))
        .when(status >= 400, F.format_string(HTTP_ERROR, status.cast("string"), dataset, level))
        .when(status.isNull() & failure.isNotNull(), F.format_string(REQUEST_ERROR, failure))
        .when(F.coalesce("n_observations", F.lit(0)) == 0, F.format_string(NO_OBSERVATIONS, dataset, level))
    )
    return responses.withColumn("error_message", message).withColumn("is_available", message.isNull())


def level_status(log: DataFrame) -> DataFrame:
    """Per level: done (a file came out), skipped (not available, with the reason) or failed."""
    done = F.coalesce(F.col("output_file"), F.lit("")) != ""
    status = F.when(done, "done").when(~F.col("is_available"), "skipped").otherwise("failed")
    fallback = F.lit(NOT_AVAILABLE)
    reason = F.when(status == "skipped", F.coalesce(F.nullif("error_message", F.lit("")), fallback))
    return log.withColumn("status", status).withColumn("reason", reason)


def run_summary(log: DataFrame) -> DataFrame:
    """Per data set: levels done, skipped and failed, overall success, and a hint after a failure."""
    status = F.col("status")
    only_oa = (F.col("levels") == 1) & F.col("only_oa")
    counted = level_status(log).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("levels"),
        *[F.count(F.when(status == s, 1)).alias(s) for s in ("done", "skipped", "failed")],
        F.bool_and(F.coalesce(F.col("geo_level") == "oa", F.lit(False))).alias("only_oa"),
    )
    hint = F.when(F.col("done") > 0, None).when(
        (F.col("skipped") > 0) & (F.col("failed") == 0),
        HINT_LEVELS,
    ).when(only_oa & (F.col("skipped") > 0), HINT_OA)
    return counted.withColumn("succeeded", F.col("done") > 0).withColumn("hint", hint).drop("only_oa")


def pick_dimensions(debug: DataFrame) -> DataFrame:
    """Dimensions of a data set and level from its batch files (dataset_id, geo_level, file_no, json):
    the first file with a sample response, else the first file that has dimensions."""
    doc = F.from_json("json", "dimensions array<string>, sample_response boolean")
    parsed = debug.select("dataset_id", "geo_level", "file_no", doc.alias("_doc")).select(
        "dataset_id", "geo_level", "file_no", F.col("_doc.dimensions").alias("dimensions"),
        F.coalesce("_doc.sample_response", F.lit(False)).alias("sample_response"),
    )
    best = F.min(F.struct((~F.col("sample_response")).alias("_rank"), "file_no", "dimensions", "sample_response"))
    picked = parsed.filter(F.size("dimensions") > 0).groupBy("dataset_id", "geo_level").agg(best.alias("_best"))
    return picked.select("dataset_id", "geo_level", "_best.file_no", "_best.dimensions", "_best.sample_response")


def combine_filter_batches(batches: Mapping[int, DataFrame]) -> DataFrame:
    """Rows of all batches under the union of their columns, in ``file_no``."""
    combined = None
    for number, batch in sorted(batches.items()):
        part = batch.withColumn("file_no", F.lit(number))
        combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    if combined is None:
        raise ValueError("no batch files to combine")
    return combined


def read_filter_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batch CSVs of one data set and level, all text, with ``file_name``: columns are matched by
    name, in one scan for each header that occurs."""
    return text_csv(spark, folder, with_file=True)
