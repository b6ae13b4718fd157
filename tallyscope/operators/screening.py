"""Screening metrics: uptake within six months and three-year round length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.functions.rules import add_months, tolerant_timestamp
from tallyscope.operators.positions import following
from tallyscope.sources.sinks import by_folder

# Days for uptake and for round length.
UPTAKE_DAYS = 183
ROUND_DAYS = 3 * 365


def _within(later: Column, earlier: Column, days: int) -> Column:
    return later <= earlier + F.make_dt_interval(days=F.lit(days))


def add_uptake_columns(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Flag attendance within 183 days of the first offered appointment; null without an offer.

    Texts that are no ISO dates are tried with ``formats`` (such as ``dd/MM/yyyy``) in turn."""
    types = dict(df.dtypes)
    parsed = df.withColumns(
        {name: tolerant_timestamp(name, types[name], formats) for name in ("date_of_as", "date_of_foa")}
    )
    attended = F.coalesce(_within(F.col("date_of_as"), F.col("date_of_foa"), UPTAKE_DAYS), F.lit(False))
    return parsed.withColumn("uptake_six_mth_threshold", F.when(F.col("date_of_foa").isNotNull(), attended))


def add_round_length_columns(df: DataFrame, tie_break: str = "episode_id") -> DataFrame:
    """Previous episode of the same person and whether the new offer came within 1095 days of it.

    Rows are taken latest offer first, ties by ``tie_break`` descending.  Needs parsed dates (see
    ``add_uptake_columns``).  Rows without a person have no previous episode.  The rows are spread by
    person and month of the offer, so a person may have a large share of all rows.
    """
    order = [F.col("date_of_foa").desc_nulls_last(), F.col(tie_break).desc()]
    offer = F.col("date_of_foa")
    month = F.coalesce(F.year(offer) * 12 + F.month(offer), F.lit(-(2**31)))
    # rows without a person are no neighbours: any bucket will do
    bucket = F.when(F.col("nhs_number").isNull(), F.hash(tie_break)).otherwise(month)
    prior = following(df, "nhs_number", order, ["date_of_as", "date_of_foa"], "_prior", bucket)
    out = (
        prior.withColumn("prior_date_of_as", F.col("_prior.date_of_as"))
        .withColumn("prior_date_of_foa", F.col("_prior.date_of_foa"))
        .withColumn("prior_episode_date", F.coalesce("prior_date_of_as", "prior_date_of_foa"))
        .drop("_prior")
    )
    return out.withColumn(
        "round_length_three_yr_threshold",
        _within(F.col("date_of_foa"), F.col("prior_episode_date"), ROUND_DAYS),
    )


def unparsed_dates(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """How many texts of each date column are not null and cannot be parsed: one row."""
    types = dict(df.dtypes)
    lost = {name: F.col(name).isNotNull() & tolerant_timestamp(name, types[name], formats).isNull() for name in ("date_of_as", "date_of_foa")}
    return df.agg(*[F.count_if(flag).alias(f"{name}_unparsed") for name, flag in lost.items()])


def enrich(df: DataFrame, tie_break: str = "episode_id", formats: Sequence[str] = ()) -> DataFrame:
    return add_round_length_columns(add_uptake_columns(df, formats), tie_break)


def _share_true(
    df: DataFrame, flag: str, name: str, aggregation: str | Sequence[str], end_date: str,
    start_date: str | None, strict: bool,
) -> DataFrame:
    keys = [aggregation] if isinstance(aggregation, str) else list(aggregation)
    end = F.lit(end_date).cast("timestamp_ntz")
    start = F.lit(start_date).cast("timestamp_ntz") if start_date else add_months(end, -12)
    rows = df.filter((F.col("date_of_foa") >= start) & (F.col("date_of_foa") <= end) & F.col(flag).isNotNull())
    if strict and rows.isEmpty():
        raise ValueError("No data found to perform calculation")
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy(*keys).agg((F.avg(F.col(flag).cast("int")) * 100).alias(name)).orderBy(*keys)


def calculate_uptake(df, aggregation, end_date, start_date=None, strict=False) -> DataFrame:
    """Percentage attended in time per key(s), for offers from start to end date inclusive.

    The start date defaults to one year before the end.  ``strict`` raises when nothing is left.
    """
    return _share_true(df, "uptake_six_mth_threshold", "uptake_pct", aggregation, end_date, start_date, strict)


def calculate_round_length(df, aggregation, end_date, start_date=None, strict=False) -> DataFrame:
    """Percentage invited within three years per key(s); the same window on the offer date."""
    return _share_true(
        df, "round_length_three_yr_threshold", "round_length_pct", aggregation, end_date, start_date, strict
    )


def metric_audit(df: DataFrame) -> DataFrame:
    """The columns that explain both flags."""
    return df.select(
        "nhs_number", "date_of_foa", "date_of_as", "prior_date_of_foa", "prior_date_of_as",
        "uptake_six_mth_threshold", "round_length_three_yr_threshold",
    )


def write_enriched(df: DataFrame, path: str) -> None:
    """Enrich once, query often: Parquet by financial year (April to March) of the offer."""
    start_year = F.year(add_months(F.col("date_of_foa"), -3))
    yearly = by_folder(df.withColumn("financial_year", start_year), "financial_year")
    yearly.write.mode("overwrite").partitionBy("financial_year").parquet(path)
