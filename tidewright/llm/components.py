"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def component_roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that each linked node reaches; nodes without links to others have no row.

    links: two columns of one orderable type.  Each round is written to the shared folder, so an executor that is lost
    costs one round.  A node with very many links only ever sends its smallest neighbour to each of them; the join
    that does so is an equi-join that adaptive execution can split.  Rounds grow with the logarithm of the longest chain.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "links")
    before = _state(edges)
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("n", "m")).distinct(), "links")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
