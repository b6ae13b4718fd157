"""Exact top-k inner products by MaxScore, over shards of vectors.

A dimension is a query term and its posting list holds the shard's components.  A term's bound is
the largest product it can add within the shard.  Terms whose bounds together stay below the score
of the k-th best row so far are not essential: only the essential ones are traversed for all rows,
and the others are probed, in falling order of their bounds, for the rows that can still compete.
The best rows of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a shard and of a block of queries: what one task holds at a time.
SHARD_ROWS = QUERY_ROWS = 8192
#: Rows scored between two updates of a query's threshold, and terms probed between two checks.
STEP_ROWS, STEP_TERMS = 2048, 8
_EXACT_FLOAT = 2.0**53


def best(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows for one query, ties to the smaller id.  ``vectors`` holds a
    row per dimension; ``ids`` ascend, so rows of equal score are met in the order that counts."""
    low, high = vectors.min(axis=1), vectors.max(axis=1)
    bounds = np.maximum(query * low, query * high)
    order = np.argsort(-bounds, kind="stable")
    # what the terms from a place on can add at most
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    scores, found = np.zeros(0, vectors.dtype), np.zeros(0, np.int64)
    for start in range(0, len(ids), STEP_ROWS):
        block = vectors[:, start : start + STEP_ROWS]
        rows = np.flatnonzero(ids[start : start + STEP_ROWS] != own)
        if len(scores) < k:
            partial, place = query @ block[:, rows], len(order)
        else:
            least = scores[-1]
            place = max(1, int(np.count_nonzero(rest[:-1] >= least)))  # the essential terms
            partial = query[order[:place]] @ block[order[:place]]
            partial = partial[rows]
            while place < len(order):
                compete = partial + rest[place] > least  # a later row of equal score has a larger id
                rows, partial = rows[compete], partial[compete]
                if not len(rows):
                    break
                terms = order[place : place + STEP_TERMS]
                partial = partial + query[terms] @ block[np.ix_(terms, rows)]
                place += STEP_TERMS
        scores = np.concatenate([scores, partial])
        found = np.concatenate([found, ids[start + rows]])
        keep = np.argsort(-scores, kind="stable")[:k]  # earlier rows have smaller ids
        scores, found = scores[keep], found[keep]
    return scores, found


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """A column per vector; missing components of shorter vectors are zero."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _unpacked(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors, each pair once."""
    ids, matrix = rows.field("id").to_numpy(zero_copy_only=False), _matrix(rows.field("v"))
    both = np.unique(np.column_stack([ids, matrix]), axis=0) if len(ids) else np.column_stack([ids, matrix])
    return both[:, 0], both[:, 1:]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            queries, theirs = _unpacked(batch.column("queries").slice(n, 1).flatten())
            ids, vectors = _unpacked(batch.column("rows").slice(n, 1).flatten())
            width = max(vectors.shape[1], theirs.shape[1])
            vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
            theirs = np.pad(theirs, ((0, 0), (0, width - theirs.shape[1])))
            largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(theirs).max(initial=0)) * max(width, 1)
            kind = np.float64 if largest < _EXACT_FLOAT else np.int64  # sums of such floats are exact
            columns, theirs = np.ascontiguousarray(vectors.T.astype(kind)), theirs.astype(kind)
            out = [(q, *best(columns, ids, query, q, k)) for q, query in zip(queries, theirs)]
            counts = [len(found) for _, _, found in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries, counts), pa.int64()),
                    pa.array(np.concatenate([f for _, _, f in out] or [[]]).astype(np.int64)),
                    pa.array(np.concatenate([s for _, s, _ in out] or [[]]).astype(np.int64)),
                ],
                names=["query_id", "vec_id", "score"],
            )


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) with v = floor(scale * x) of each component.  Rows whose id or vector is null, or whose
    vector holds null or non-finite components, take no part."""
    x = lambda c: c.cast("double")
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda c: F.floor(x(c) * scale)).alias("v"))


def search(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k best rows for each query among ``rows`` (id, v).

    Queries are the rows for which ``is_query`` holds; a query never meets rows of its own id.  Ties
    go to the smaller id.  Shorter vectors count as padded with zeros, an empty one scores 0.  Rows
    repeated with the same id and vector count once.  With fewer than k other rows all are returned,
    an empty table gives none.  Scores are exact within the range of a long.

    Shards of rows meet blocks of queries, every pair once.  Both are dealt by a hash of the id, so
    their sizes are bounded by the counts, and a task holds one pair at a time.
    """
    total, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = 1 + total // SHARD_ROWS, 1 + asked // QUERY_ROWS
    tasks = min(shards * blocks, 20_000)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, name: str) -> DataFrame:
        packed = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(own)).agg(F.collect_list(F.struct("id", "v")).alias(name))
        return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))).repartition(tasks, "_shard", "_block")

    stored = dealt(rows, "_shard", shards, "_block", blocks, "rows")
    asking = dealt(rows.filter(is_query), "_block", blocks, "_shard", shards, "queries")
    pairs = stored.join(asking, ["_shard", "_block"]).select("rows", "queries")
    found = pairs.mapInArrow(lambda batches: _search(batches, k), "query_id bigint, vec_id bigint, score bigint")
    first = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
