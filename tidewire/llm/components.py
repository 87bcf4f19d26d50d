"""Connected components of an edge list by alternating star contractions, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a long, b long); root is the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, onto its least neighbour, until all components
    are stars around their least node: a logarithm of the longest path in rounds, and always an end, since roots only fall.
    Lineage is cut each round by checkpoint(), in the shared folder, in parts of about `EDGES` edges. A hub's
    neighbours are never gathered: the least one is a map-side combined aggregate, joined back.
    Defined cases: repeated edges count once; an edge from a node to itself, and one with a null end, are no edges, so that
    a node without others isn't in the result; an empty table gives an empty result; other columns are ignored."""
    shared_dir(edges.sparkSession)
    a, b = F.col("a"), F.col("b")
    edges = edges.filter("a != b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = edges.distinct().coalesce(edges.count() // EDGES + 1).checkpoint()
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        # in a star forest a node has larger neighbours only, or one smaller one
        mixed, ends = least.agg(F.count_if(F.expr("m < a AND c > 1")), F.sum("c")).first()
        if not mixed:
            break
        least = least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(down, F.col("a") == F.col("n")).select("b", "m").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.union(down.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct().coalesce(ends // EDGES + 1).checkpoint()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
