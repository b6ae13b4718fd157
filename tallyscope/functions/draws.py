"""Seeded draws as plain column expressions.

A draw depends on the row key, a name and a seed, so a retried task, another partitioning or
another engine gives the same value.  ``fast=True`` swaps md5 for xxhash64 (cheaper, Spark only).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def unit(key: Column, name: str, seed: int | str | Column, fast: bool = False) -> Column:
    """Uniform double in [0, 1), a multiple of 2^-52."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", key.cast("string"), F.lit(name), seed)
    if fast:
        bits = F.shiftrightunsigned(F.xxhash64(text), 12)
    else:
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(2.0**52)


def bernoulli(key: Column, name: str, p: float, seed, fast: bool = False) -> Column:
    return unit(key, name, seed, fast) < F.lit(float(p))


def uniform_int(key: Column, name: str, lo, hi, seed, fast: bool = False) -> Column:
    """Uniform bigint in the closed range lo..hi, of up to 2^52 values; the bounds may be columns."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    span = hi.cast("bigint") - lo.cast("bigint") + 1
    return lo.cast("bigint") + F.floor(unit(key, name, seed, fast) * span).cast("bigint")


def choose(key: Column, name: str, values: Sequence, seed, weights=None, fast: bool = False) -> Column:
    """One of ``values``; evenly, or by weights that sum to 1."""
    u = unit(key, name, seed, fast)
    if weights is None:
        options = F.array(*[F.lit(value) for value in values])
        return F.element_at(options, (F.floor(u * len(values)) + 1).cast("int"))
    picked, edge = F, 0.0
    for value, weight in list(zip(values, weights))[:-1]:
        edge = round(edge + weight, 12)
        picked = picked.when(u < F.lit(edge), F.lit(value))
    return picked.otherwise(F.lit(values[-1]))


def uniform_date(key: Column, name: str, first: str, last: str, seed, fast: bool = False) -> Column:
    """Uniform date in the closed range of ISO dates."""
    start = F.lit(first).cast("date")
    days = F.datediff(F.lit(last).cast("date"), start)
    return F.date_add(start, uniform_int(key, name, F.lit(0), days, seed, fast).cast("int"))
