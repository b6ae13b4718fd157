"""Exact dedup by distributed MSD radix partitioning.

Groups of texts are split by their length and first bytes, then again and again by the next bytes,
until a group has one member or its texts have ended.  Members of a group that ended agree in every
byte, so equality rests on the bytes themselves and on no digest.  A level reads 16 times the bytes
of all levels before it, so a text of n bytes needs about log16(n) levels.  Splitting is an
aggregate with a combine before the shuffle, so copies of one text cost a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.llm.common import SPACE, staged

FIRST_BYTES, GROWTH = 16, 16


def one_spaced(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]{{2,}}|[\\x09-\\x0D]", " ")


def _split(active: DataFrame, keys: list[str], digit: Column, width: int) -> DataFrame:
    """One level: every active row with its subgroup's ``_first`` row, smallest id and ``_size``.
    Rows go on (``_rest`` not null) while their subgroup has other members and bytes are left."""
    rows = active.withColumn("_digit", digit)
    groups = rows.groupBy(*keys, "_digit").agg(
        F.coalesce(F.min_by("_row", "id"), F.min("_row")).alias("_next"), F.min("id").alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    on = (F.col("_n") > 1) & (F.octet_length("_rest") > width)
    placed = rows.drop("keep_id", "group_size").join(groups, [*keys, "_digit"])
    return placed.select(
        "_row", "id", F.col("_next").alias("_first"), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), "text_sha256",
        F.when(on, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """(_row, id, keep_id, group_size, kept, text_sha256) for rows (_row, id, text) with unique ``_row``.

    Texts are equal when identical after ``one_spaced``; null counts as empty.  Of equal texts the row
    with the smallest id stays, a null id only where the group has no other; of rows repeated with that
    id exactly one.  An empty table gives no rows.
    """
    text = one_spaced(F.col("text"))
    active = rows.select("_row", "id", F.encode(text, "UTF-8").alias("_rest"))
    active = active.withColumns({"_length": F.octet_length("_rest"), "text_sha256": F.sha2("_rest", 256)})
    width, keys, settled = FIRST_BYTES, ["_length"], []
    while True:
        level = staged(_split(active, keys, F.expr(f"substring(_rest, 1, {width})"), width), "radix")
        settled.append(level.filter("_rest is null").drop("_rest"))
        active, keys = level.filter("_rest is not null"), ["_first"]
        if active.isEmpty():
            break
        width = width * GROWTH if len(settled) > 1 else FIRST_BYTES * (GROWTH - 1)
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.withColumn("kept", F.col("_row") == F.col("_first")).drop("_first")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``groups`` of a table's rows.  Only the two named columns are read."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return groups(staged(rows, "texts"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever those are called."""
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")), "documents")
    found = groups(numbered.select("_row", F.col("_doc")[id_col].alias("id"), F.col("_doc")[text_col].alias("text")))
    return numbered.join(found.filter("not kept").select("_row"), "_row", "left_anti").select("_doc.*")


DUPLICATES_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
