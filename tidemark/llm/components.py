"""Connected components of a link table by hooking to the smallest neighbour and contracting, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, gathered, small_side


def components(links: DataFrame) -> DataFrame:
    """(_node, _root) for every node of links (_a, _b); _root is the smallest node of the component.

    In a round every node points to its smallest neighbour, or stays if it is smaller itself; pointers are followed twice, and links
    between nodes with different pointers go on. Rounds follow the logarithm of the longest chain, and each works on what is left.
    Pointers are broadcast where they are few, so that a small table of links isn't shuffled for each of these steps.
    """
    links = cut(links.select("_a", "_b").where("_a <> _b").distinct())
    labels, rows = None, links.count()
    few = lambda df: cut(gathered(df, rows))  # noqa: E731 (no table of a round has more than some links' rows)
    while labels is None or not links.isEmpty():
        both = links.select(F.inline(F.array(F.struct("_a", "_b"), F.struct(F.col("_b").alias("_a"), F.col("_a").alias("_b")))))
        point = few(both.groupBy("_a").agg(F.min("_b").alias("_p")).select("_a", F.least("_a", "_p").alias("_p")))
        jump = small_side(point.select(F.col("_a").alias("_p"), F.col("_p").alias("_q")))
        for _ in range(2):  # every pointer's end is in the table, for it is a node of a link itself
            point = point.join(jump, "_p").select("_a", F.col("_q").alias("_p"))
        point = small_side(few(point))
        labels = point.select(F.col("_a").alias("_node"), F.col("_p").alias("_root")) if labels is None else labels.join(point.select(F.col("_a").alias("_root"), "_p"), "_root", "left").select("_node", F.coalesce("_p", "_root").alias("_root"))
        labels = few(labels)
        ends = links.join(point, "_a").select("_b", F.col("_p").alias("_x")).join(point.select(F.col("_a").alias("_b"), "_p"), "_b")
        links = few(ends.select(F.least("_x", "_p").alias("_a"), F.greatest("_x", "_p").alias("_b")).where("_a <> _b").distinct())
    return labels


def with_links(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (_node, _root) after the links (_a, _b) have been added; only the roots are worked on."""
    known = small_side(roots)
    for end in ("_a", "_b"):
        more = more.join(known.select(F.col("_node").alias(end), F.col("_root").alias("_r")), end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    above = small_side(components(more))
    moved = roots.join(above.select(F.col("_node").alias("_root"), F.col("_root").alias("_top")), "_root", "left").select("_node", F.coalesce("_top", "_root").alias("_root"))
    return cut(moved.unionByName(above.join(known.select("_node"), "_node", "left_anti")))
