"""Catalog of census data sets: build, count, page, list; dimension and area lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyscope.operators.census import dataset_type
from tallyscope.operators.positions import number_rows

# Descriptions of data sets found by links only; geographic level names.
LINK_DESCRIPTION = "Census 2021 dataset"
OBSERVATION_DESCRIPTION = "Census 2021 dataset discovered via census-observations"
GEOGRAPHIC_NAMES = ("ctry", "rgn", "la", "ltla", "msoa", "lsoa", "oa")
TYPES = ("TS", "RM", "OTHER")

_ITEMS = "items array<map<string,string>>"


def explode_items(documents: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The ``items`` of JSON documents, one row each; absent fields are blank."""
    items = documents.select(*keep, F.explode(F.from_json("json", _ITEMS)["items"]).alias("_item"))
    return items.select(*keep, *[F.coalesce(F.col("_item")[f], F.lit("")).alias(f) for f in fields])


def linked_dataset(href: Column) -> Column:
    """Data set id that follows the first ``datasets`` in a link; blank without one."""
    rest = F.split_part(F.concat(F.lit("/"), href), F.lit("/datasets/"), F.lit(2))
    return F.when(href.contains("/datasets/"), F.substring_index(rest, "/", 1)).otherwise("")


def _census_links(links: DataFrame, rank: int) -> DataFrame:
    ids = links.select(linked_dataset(F.col("href")).alias("id"), F.lit(rank).alias("_rank"))
    return ids.filter(F.substring("id", 1, 2).isin("TS", "RM"))


def build_catalog(
    pages: DataFrame, links: DataFrame, metadata: DataFrame, observation_links: DataFrame, sort: bool = True
) -> DataFrame:
    """Listed data sets, then census data sets known only by dimension links (with their metadata
    where there is any), then those known only by observation links; sorted by id unless the result
    is worked on further.

    ``pages(json)``, ``links(href)``, ``metadata(dataset_id, json)`` for successful lookups only.
    Listed ids and both kinds of links go through one aggregate (combined map-side) that keeps the
    first way an id was found.
    """
    listed = explode_items(pages, ("id", "title", "description"))
    default = F.concat(F.lit("Census 2021 - "), F.col("id"))
    meta = metadata.select(
        F.col("dataset_id").alias("id"), F.from_json("json", "title string, description string").alias("_meta")
    )
    looked_up = F.col("_meta").isNotNull() & (F.col("_rank") == 1)
    found = (
        listed.select("id", F.lit(0).alias("_rank"))
        .unionByName(_census_links(links, 1))
        .unionByName(_census_links(observation_links, 2))
        .groupBy("id")
        .agg(F.min("_rank").alias("_rank"))
        .filter(F.col("_rank") > 0)
        .join(meta, "id", "left")
        .select(
            "id",
            F.when(looked_up, F.coalesce("_meta.title", default)).otherwise(default).alias("title"),
            F.when(looked_up, F.coalesce("_meta.description", F.lit("")))
            .when(F.col("_rank") == 1, LINK_DESCRIPTION)
            .otherwise(OBSERVATION_DESCRIPTION)
            .alias("description"),
        )
    )
    catalog = listed.unionByName(found)
    return catalog.orderBy("id") if sort else catalog


def with_type(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("dataset_type", dataset_type(F.col("id")))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Data sets per type, types without any included, and the total."""
    counts = with_type(catalog).agg(
        *[F.count(F.when(F.col("dataset_type") == t, 1)).alias(t) for t in TYPES], F.count(F.lit(1)).alias("TOTAL")
    )
    names = F.array(*[F.struct(F.lit(t).alias("dataset_type"), F.col(t).alias("datasets")) for t in (*TYPES, "TOTAL")])
    return counts.select(F.inline(names))


def top_n_per_type(catalog: DataFrame, n: int = 5, types: Sequence[str] = TYPES) -> DataFrame:
    """The first ``n`` data sets of each of the given types by id, and how many more there are.

    Other types are listed in full.  The ranking filter is applied before the shuffle too.
    """
    typed = with_type(catalog)
    cut = F.col("dataset_type").isin(*types)
    totals = typed.groupBy("dataset_type").agg(F.count(F.lit(1)).alias("_total"))
    # equal ids are told apart by their text
    by_id = W.partitionBy("dataset_type").orderBy("id", "title", "description")
    first = typed.filter(cut).withColumn("_no", F.row_number().over(by_id)).filter(F.col("_no") <= n).drop("_no")
    columns = ["dataset_type", "id", "title", "description"]
    # only the few rows that stay of a type meet its total
    short = first.join(totals, "dataset_type").select(*columns, F.greatest(F.col("_total") - n, F.lit(0)).cast("bigint").alias("more"))
    return short.unionByName(typed.filter(~cut).select(*columns, F.lit(0).cast("bigint").alias("more")))


def page_number(catalog: DataFrame, size: int = 10) -> DataFrame:
    """Page of each data set within its type, pages from 1, ``size`` to a page."""
    numbered = number_rows(
        with_type(catalog), [F.col("id"), F.col("title"), F.col("description")], ["dataset_type"], "_no"
    )
    return numbered.withColumn("page", F.expr(f"_no div {size} + 1")).drop("_no")


def truncate_text(text: Column, limit: int = 200) -> Column:
    """Texts longer than the limit end in three dots, limit characters in all."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def category_dims(dims: DataFrame, name: str = "name") -> DataFrame:
    """Dimensions that are not geographic levels."""
    return dims.filter(~F.lower(F.col(name)).isin(*GEOGRAPHIC_NAMES))
