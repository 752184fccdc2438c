"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.common import cut_lineage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links``: two long columns (a, b). Returns (node, root): each node with the smallest node it reaches.

    Rounds of large-star and small-star: every node's neighbours are hung below
    the smallest one until only stars are left, which takes a number of rounds
    that grows with the logarithm of the longest chain. Only the smallest
    neighbour is aggregated for each node, before the shuffle, so a hub with many
    neighbours costs no more than others; the joins back are split if skewed.

    Links from a node to itself and repeated links do no harm; links with a null
    end are left out; no links give no rows.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    for _ in range(most_rounds):
        if _only_stars(edges):
            break
        edges = cut_lineage(_round(edges))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _round(edges: DataFrame) -> DataFrame:
    """Large-star: larger neighbours are hung below the smallest one; small-star: smaller ones and the node itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.join(low, F.col("u") == F.col("k")).where(F.col("v") > F.col("u"))
    large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    pairs = large.join(low, F.col("u") == F.col("k"))
    small = pairs.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node that hangs below another hangs below one alone, which hangs below none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()
