"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is an aggregation and a join on Spark; nothing is collected. The links come
from representatives and are few; a representative with very many links has them in
one task of the join, as pairs of numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v) with u > v."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # A node that is its own least keeps the links that its larger neighbours send.
    return out.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; ``component`` is the least node reachable."""
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        edges = written(_star(_star(edges, small=False), small=True), "links")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
