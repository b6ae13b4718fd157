"""Row numbers, running totals and neighbours that never put a whole table or group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyscope.session import pin

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows range-partitioned and sorted once, with their partition ``_part`` and place ``_idx``.

    They are written to the checkpoint folder, so both are stable facts.  A group that fills many
    partitions stays in all of them."""
    by = [F.col(k) for k in keys] + list(order)
    pinned = pin(df.repartitionByRange(*by).sortWithinPartitions(*by))
    mono = F.monotonically_increasing_id()
    return pinned.withColumns(
        {"_part": F.shiftright(mono, _LOCAL_BITS), "_idx": mono.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))}
    )


def _with_heads(placed: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins what is known of each (partition, group) to its rows: no row is joined by its group alone.

    Without keys that is one short row per partition, so it is sent to the rows and these stay where they are."""
    renamed = heads.withColumnsRenamed({k: f"_of_{k}" for k in ["_part", *keys]})
    renamed = renamed if keys else F.broadcast(renamed)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in ["_part", *keys]]
    return placed.join(renamed, same).drop(*[f"_of_{k}" for k in ["_part", *keys]])


def _earlier(keys: Sequence[str]):
    """Window over the earlier partitions of a group: one row per partition and group."""
    return W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "row_no"
) -> DataFrame:
    """0-based row number within ``keys`` by ``order`` (must be unique within the keys).

    Only one count per partition and group is summed up in a window; null keys are a group."""
    placed = _placed(df, keys, order)
    heads = placed.groupBy("_part", *keys).agg(F.min("_idx").alias("_from"), F.count(F.lit(1)).alias("_size"))
    heads = heads.withColumn("_start", F.coalesce(F.sum("_size").over(_earlier(keys)), F.lit(0)) - F.col("_from")).drop("_from", "_size")
    return _with_heads(placed, heads, keys).withColumn(name, F.col("_start") + F.col("_idx")).drop("_part", "_idx", "_start")


def running_offset(
    df: DataFrame, value: str, order: str, keys: Sequence[str] = (), name: str = "offset"
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, by ``order`` (unique within the keys).

    Running sums inside a partition, and sums over the earlier partitions' totals.  Null orders come
    first, null keys are a group, and a null value counts as 0."""
    placed = _placed(df, keys, [F.col(order)])
    amount = F.coalesce(F.col(value), F.lit(0))
    heads = placed.groupBy("_part", *keys).agg(F.sum(amount).alias("_total"))
    heads = heads.withColumn("_base", F.coalesce(F.sum("_total").over(_earlier(keys)), F.lit(0))).drop("_total")
    inner = W.partitionBy("_part", *keys).orderBy("_idx").rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return _with_heads(local, heads, keys).withColumn(name, F.col("_local") + F.col("_base")).drop("_part", "_idx", "_local", "_base")


def following(df: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str], name: str, bucket: Column) -> DataFrame:
    """``name``: a struct of ``fields`` of the next row with the same ``key`` by ``order``, or null.

    ``bucket`` is a whole number, never null, that does not grow along the order (the month, for rows by
    falling date).  The rows are dealt once, by key and bucket, so the rows of one key are spread over
    its buckets; the next row is looked up inside the bucket, and the last one of a bucket is followed
    by the first row of the key's next bucket.  Only these first rows, with no other columns than
    ``fields``, move a second time.  Rows with a null key have no next row; their bucket should be
    spread by the caller."""
    own = W.partitionBy(key, "_bucket").orderBy(*order)
    dealt = df.withColumn("_bucket", bucket).repartition(key, "_bucket")
    found = dealt.withColumns({"_own": F.struct(*fields)}).withColumns({"_next": F.lead("_own").over(own), "_n": F.row_number().over(own)})
    firsts = found.filter((F.col("_n") == 1) & F.col(key).isNotNull()).select(key, "_bucket", "_own")
    after = F.lead("_own").over(W.partitionBy(key).orderBy(F.col("_bucket").desc()))
    heads = firsts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), after.alias("_after")).filter("_after IS NOT NULL")
    joined = found.join(heads, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_of")), "left")
    last = F.when(F.col(key).isNotNull(), F.coalesce("_next", "_after"))
    return joined.withColumn(name, last).drop("_bucket", "_own", "_next", "_n", "_key", "_of", "_after")
