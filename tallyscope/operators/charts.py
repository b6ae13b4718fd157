"""Data behind the reader-quality charts (ellipses, quadrants, funnel).

Overall means and limits are one-row aggregates used as scalar subqueries.  Empty input gives
empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.operators.reading import Tables, _decision_counts, _detected_counts, _for_all_readers

# Grid size of the funnel limits, normal quantile, ellipse multiples.
GRID_POINTS = 300
NORMAL_95 = 1.96
SIGMAS = (1, 2, 3)


def _number(name: str) -> Column:
    return F.col(name).cast("string").try_cast("double")


def ellipse_params(summary: DataFrame) -> DataFrame:
    """Centre, population deviations and ellipse sizes of recall rate against discrepant rate."""
    points = summary.select(
        _number("Recall Rate").alias("x"), _number("Discrepant Cancer Rate").alias("y")
    ).dropna()
    moments = points.agg(
        F.avg("x").alias("x_mean"),
        F.avg("y").alias("y_mean"),
        F.stddev_pop("x").alias("x_std"),
        F.stddev_pop("y").alias("y_std"),
    )
    sized = moments.select("*", F.explode(F.array(*[F.lit(k) for k in SIGMAS])).alias("sigma")).select(
        "sigma",
        "x_mean",
        "y_mean",
        "x_std",
        "y_std",
        (2 * F.col("sigma") * F.col("x_std")).alias("width"),
        (2 * F.col("sigma") * F.col("y_std")).alias("height"),
    )
    return sized.filter((F.col("width") > 0) & (F.col("height") > 0))


def quadrants(summary: DataFrame) -> DataFrame:
    """Each reader's quadrant against the mean recall rate (x) and detection rate (y).

    A reader on the line belongs to the left and to the top.
    """
    points = summary.select(
        "Unique Code",
        _number("Recall Rate").alias("Recall Rate"),
        _number("Cancer Detection Rate").alias("Cancer Detection Rate"),
    ).dropna(subset=["Recall Rate", "Cancer Detection Rate"])
    means = points.agg(
        F.struct(F.avg("Recall Rate").alias("x"), F.avg("Cancer Detection Rate").alias("y")).alias("means")
    ).scalar()
    placed = points.withColumns({"x_mean": means["x"], "y_mean": means["y"]})
    left = F.col("Recall Rate") <= F.col("x_mean")
    top = F.col("Cancer Detection Rate") >= F.col("y_mean")
    label = (
        F.when(left & top, "better sensitivity and specificity")
        .when(top, "better sensitivity")
        .when(left, "better specificity")
        .otherwise("poorer sensitivity and specificity")
    )
    return placed.withColumn("quadrant", label)


def funnel_points(tables: Tables, summary: DataFrame) -> DataFrame:
    """Number of first reads per reader against the detection rate; readers without any drop out."""
    first_reads = (
        tables["ReadEpisode"]
        .filter(F.col("first_reader_id").isNotNull())
        .groupBy(F.col("first_reader_id").alias("Unique Code"))
        .agg(F.count(F.lit(1)).alias("Number of first reads"))
    )
    return (
        summary.select("Unique Code", _number("Cancer Detection Rate").alias("Cancer Detection Rate"))
        .join(first_reads, "Unique Code", "left")
        .na.fill(0, ["Number of first reads"])
        .dropna(subset=["Cancer Detection Rate"])
        .filter(F.col("Number of first reads") > 0)
    )


def funnel_limits(tables: Tables, points: DataFrame, all_readers: DataFrame | None = None) -> DataFrame:
    """95% limits around the overall detection rate on an even grid of read counts.

    The overall rate covers all readers, whatever filter made ``points``.  It comes from the
    unfiltered summary if ``all_readers`` gives it (the work is then shared), else from the tables.
    """
    if all_readers is None:
        hits = _detected_counts(tables, "cancers_detected_count")
        counts = _for_all_readers(
            tables,
            _decision_counts(tables).join(hits, "reader_id", "left"),
            "read_decision_count",
            "cancers_detected_count",
        )
    else:
        counts = all_readers.select(
            F.col("Total Cases Reported as First & Second Reader").alias("read_decision_count"),
            F.col("Total Cancers Detected").alias("cancers_detected_count"),
        )
    totals = counts.agg(F.sum("cancers_detected_count").alias("hits"), F.sum("read_decision_count").alias("reads"))
    overall = totals.select(
        F.coalesce(F.col("hits") / F.nullif(F.col("reads"), F.lit(0)), F.lit(0.0)).alias("p")
    ).scalar()
    span = points.agg(
        F.greatest(F.lit(1), F.min("Number of first reads")).cast("double").alias("first"),
        F.max("Number of first reads").cast("double").alias("last"),
    ).filter(F.col("last").isNotNull())
    grid = (
        span.withColumn("p", overall)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))).alias("grid_no"))
        .withColumn(
            "number_of_first_reads",
            F.col("first") + F.col("grid_no") * ((F.col("last") - F.col("first")) / F.lit(GRID_POINTS - 1)),
        )
    )
    p = F.col("p")
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / F.col("number_of_first_reads"))
    return grid.select(
        F.col("grid_no").cast("bigint").alias("grid_no"),
        "number_of_first_reads",
        (p * 1000).alias("centre"),
        F.greatest((p - NORMAL_95 * error) * 1000, F.lit(0.0)).alias("lower_95"),
        ((p + NORMAL_95 * error) * 1000).alias("upper_95"),
    )
