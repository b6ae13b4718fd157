"""Noise for wide count tables.

Every cell's draw is keyed by its row key, column name and seed, so the result does not depend on
partitioning and a retried task repeats it.  One projection per table, no shuffle.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.functions.draws import unit
from tallyscope.session import pin

# The key columns, which are never changed, and the two parameters.
KEY_COLUMNS = ("kc63_output_by_run_id", "col_b", "col_c")
THRESHOLD = 10
SMEAR = 0.5

_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
_FLOAT_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_MAX_BIGINT = 9223372036854775807


def perturbed_integer(value: Column, u: Column, threshold: int = THRESHOLD, smear: float = SMEAR) -> Column:
    """Above the threshold: uniform within the smear around the value; otherwise uniform 0..threshold.
    The upper end of the range is the largest bigint at most."""
    deviation = value * F.lit(float(smear))
    low = F.greatest(F.lit(0), (value - deviation).try_cast("bigint"))
    high = F.coalesce((value + deviation).try_cast("bigint"), F.lit(_MAX_BIGINT))
    big = value > threshold
    low = F.when(big, low).otherwise(F.lit(0)).cast("bigint")
    high = F.when(big, high).otherwise(F.lit(threshold)).cast("bigint")
    # in doubles, as the span of a capped range is one more than a bigint can hold
    steps = F.floor(u * (high.cast("double") - low.cast("double") + 1)).cast("bigint")
    return low + F.least(steps, high - low)


def perturbed_float(u: Column) -> Column:
    """Uniform 0..100 with two decimals, whatever the value was."""
    return F.bround(u * 100, 2)


def perturb_cell(column: str, data_type: str, u: Column, threshold: int, smear: float) -> Column:
    """The cell with noise; text, missing and over-long integers stay as they are."""
    cell = F.col(column)
    if data_type in ("tinyint", "smallint", "int", "bigint"):
        return perturbed_integer(cell.cast("bigint"), u, threshold, smear)
    if data_type in ("float", "double"):
        return F.when(cell.isNotNull(), perturbed_float(u))
    if data_type != "string":
        return cell
    whole = F.when(cell.rlike(_INTEGER_TEXT), F.trim(F.regexp_replace(cell, r"\s", "")).try_cast("bigint"))
    as_int = perturbed_integer(whole, u, threshold, smear).cast("string")
    number = cell.rlike(_FLOAT_TEXT) & ~cell.rlike(_INTEGER_TEXT)
    # a number too large for a double stays as it is; infinity in words does not
    is_float = number & (cell.rlike("[iI]") | (F.abs(F.trim(cell).try_cast("double")) < float("inf")))
    return F.when(whole.isNotNull(), as_int).when(is_float, perturbed_float(u).cast("string")).otherwise(cell)


def perturb(
    df: DataFrame,
    exclude: Sequence[str] = KEY_COLUMNS,
    threshold: int = THRESHOLD,
    smear: float = SMEAR,
    seed: int | str | Column = 0,
    fast: bool = False,
) -> DataFrame:
    """Noise in every column except ``exclude``, which together must identify a row."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in exclude])
    return df.select(
        *[
            F.col(name)
            if name in exclude
            else perturb_cell(name, kind, unit(key, name, seed, fast), threshold, smear).alias(name)
            for name, kind in df.dtypes
        ]
    )


def replicate_for_dates(
    df: DataFrame, dates: Sequence[str], exclude: Sequence[str] = KEY_COLUMNS, seed: int | str = 0, **options
) -> DataFrame:
    """An independently perturbed copy per date, in an ``as_of`` column."""
    copies = df.withColumn("as_of", F.explode(F.array(*[F.lit(date) for date in dates])))
    return perturb(copies, [*exclude, "as_of"], seed=seed, **options)


def order_bits(value: Column) -> Column:
    """A double that is not negative as the whole number of its bits, which has the same order.

    Infinity comes after all numbers, and then NaN."""
    e = F.floor(F.log2(value))
    # the logarithm may round to the wrong side of a power of two
    e = e - F.when(value < F.pow(F.lit(2.0), e), 1).otherwise(0)
    e = e + F.when(value >= F.pow(F.lit(2.0), e + 1), 1).otherwise(0)
    mantissa = ((value / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0**52)).cast("bigint")
    top = F.lit(2047 << 52)
    return (
        F.when(F.isnan(value), top + 1)
        .when(value == float("inf"), top)
        .when(value < F.lit(2.0**-1022), (value / F.lit(2.0**-1074)).cast("bigint"))
        .otherwise(F.shiftleft((e + 1023).cast("bigint"), 52) + mantissa)
    )


def _of_bits(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def ranked_values(df: DataFrame, wanted: Mapping[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """The values of the wanted 0-based ranks of each column of doubles that are not negative or null.

    By selection, digit by digit: a pass counts the values of each column by their next bits, among
    those that share the bits of a wanted rank so far.  Counts are made in the tasks and only they
    move, at most 2,048 (in the first pass: exponents and eight more bits) for each column and rank.
    Five passes find any rank of any number of rows, and no rows are sorted or sent anywhere."""
    names = list(wanted)
    state = {(name, rank): (0, rank) for name in names for rank in wanted[name]}  # bits so far, rank among these
    bits = df.select(*[order_bits(F.col(name)).alias(f"_{i}") for i, name in enumerate(names)])
    before = 63
    for shift in (44, 33, 22, 11, 0):
        open_ = {name: sorted({state[name, rank][0] for rank in wanted[name]}) for name in names}
        digits = [
            F.when(F.shiftright(f"_{i}", before).isin(open_[name]), F.shiftright(f"_{i}", shift))
            for i, name in enumerate(names)
        ]
        cells = bits.select(F.posexplode(F.array(*digits)).alias("at", "digit")).filter("digit IS NOT NULL")
        counts: dict[str, list[tuple[int, int]]] = {}
        for row in cells.groupBy("at", "digit").count().collect():
            counts.setdefault(names[row["at"]], []).append((row["digit"], row["count"]))
        for (name, rank), (prefix, left) in state.items():
            for digit, count in sorted(counts[name]):
                if digit >> (before - shift) != prefix:
                    continue
                if left < count:
                    state[name, rank] = digit, left
                    break
                left -= count
        before = shift
    return {name: {rank: _of_bits(state[name, rank][0]) for rank in wanted[name]} for name in names}


def perturbation_report(
    new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of the absolute differences, rounded
    to whole numbers: one row per column that has differences.  Raises on cells that are not numbers.

    The quartiles interpolate between two ranked values, which are found by ``ranked_values``: a
    column's values are never gathered, sorted or dealt by the column's name.
    """
    columns = list(columns or [c for c in old.columns if c not in keys])
    joined = new.select(*keys, *[F.col(c).cast("double").alias(f"new_{c}") for c in columns]).join(
        old.select(*keys, *[F.col(c).cast("double").alias(f"old_{c}") for c in columns]), list(keys)
    )
    # computed once: the passes below read the checkpointed differences
    diffs = pin(joined.select(*[F.abs(F.col(f"new_{c}") - F.col(f"old_{c}")).alias(c) for c in columns]))
    statistics = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    moments = diffs.agg(*[of(F.col(c)).alias(f"{name} {i}") for i, c in enumerate(columns) for name, of in statistics.items()]).first()
    found = {c: {name: moments[f"{name} {i}"] for name in statistics} for i, c in enumerate(columns)}
    found = {c: stats for c, stats in found.items() if stats["count"]}
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    places = {c: {name: share * (stats["count"] - 1) for name, share in shares.items()} for c, stats in found.items()}
    ranks = {c: sorted({edge(at) for at in of.values() for edge in (math.floor, math.ceil)}) for c, of in places.items()}
    values = ranked_values(diffs, ranks) if ranks else {}
    rows = []
    for c, stats in found.items():
        quartiles = {}
        for name, at in places[c].items():
            low, high = values[c][math.floor(at)], values[c][math.ceil(at)]
            quartiles[name] = low if low == high else low + (high - low) * (at - math.floor(at))
        rows.append((c, stats["count"], stats["mean"], stats["std"], stats["min"], *quartiles.values(), stats["max"]))
    names = ["mean", "std", "min", *shares, "max"]
    table = old.sparkSession.createDataFrame(rows, "column string, count bigint, " + ", ".join(f"{name} double" for name in names))
    return table.select("column", "count", *[F.bround(name, 0).alias(name) for name in names])


def preview(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)
