"""Shared column rules: ratios, truth by text, tolerant parsing, exact durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: the decision text that counts as a recall.
RECALL = "Recall for Assessment"


def ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """``numerator / denominator * scale`` to 2 places, half to even; 0 when undefined."""
    raw = numerator / F.nullif(denominator, F.lit(0)) * F.lit(scale)
    return F.coalesce(F.bround(raw, 2), F.lit(0.0))


def says_true(col: Column) -> Column:
    """True only for the word 'true' in any case; nulls and other words are false."""
    return F.coalesce(F.lower(col.cast("string")) == "true", F.lit(False))


def is_recall(col: Column) -> Column:
    return F.coalesce(col == RECALL, F.lit(False))


def count_true(flag: Column) -> Column:
    """Rows where ``flag`` holds, as bigint; nulls do not count."""
    return F.count(F.when(flag, F.lit(1)))


def tolerant_timestamp(name: str, data_type: str, formats: Sequence[str] = ()) -> Column:
    """Text becomes a timestamp or null, as ISO or in the first of ``formats`` that fits; dates and
    timestamps pass through."""
    if data_type == "string":
        tried = [F.try_to_timestamp(F.col(name), F.lit(f)).cast("timestamp_ntz") for f in formats]
        return F.coalesce(F.col(name).try_cast("timestamp_ntz"), *tried)
    return F.col(name)


def micros_between(start: Column, end: Column) -> Column:
    """Signed microseconds from start to end, independent of the session time zone."""
    gap = end - start
    whole = (
        (F.extract(F.lit("DAY"), gap).cast("bigint") * 24 + F.extract(F.lit("HOUR"), gap)) * 60
        + F.extract(F.lit("MINUTE"), gap)
    ) * 60000000
    return whole + (F.extract(F.lit("SECOND"), gap) * 1000000).cast("bigint")


def add_days(col: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return col + F.make_dt_interval(days=days.cast("int"))


def add_months(col: Column, months: Column | int) -> Column:
    """Calendar shift that clamps to the month end and keeps the time of day."""
    months = F.lit(months) if isinstance(months, int) else months
    return col + F.make_ym_interval(F.lit(0), months.cast("int"))
