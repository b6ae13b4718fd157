"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.common import discarded, staged


def _star(links: DataFrame) -> DataFrame:
    """One large star and one small star: links (a, b) with a > b, pulled towards the smallest node."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = large.join(least, large["a"] == least["u"])
    moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _settled(state: DataFrame) -> bool:
    """Whether every node has one smaller node, and that one has none."""
    nodes = state.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
    onward = nodes.join(nodes.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return nodes.filter("n > 1").select("a").unionByName(onward).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes, the label being the smallest node of the component.

    ``links`` has integer columns a and b.  A round reads and writes one table of links, at most as
    many as there are nodes and links, and the number of rounds grows with the logarithm of the
    longest path.  No links give no rows."""
    state = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while not _settled(state):
        before, state = state, staged(_star(state), "links")
        discarded(before)
    tops = state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after further links: only the labels that these join are looked at."""
    one, two = (labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in ("a", "b"))
    known = links.join(one, "a", "left").join(two, "b", "left")
    edges = staged(known.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "edges")
    tops = components(edges.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    ends = edges.select(F.col("a").alias("node"), F.col("la").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("lb").alias("label")))
    moved = labels.unionByName(ends).distinct().join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    return moved.select("node", F.coalesce("top", "label").alias("label"))
