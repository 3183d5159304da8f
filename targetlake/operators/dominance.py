"""Offline dominance counting: how many points lie at or below each corner in every coordinate.

Coordinates are whole numbers from 0. The first one is dealt with by sorting: points
and corners are put in one order and running sums are read off at the corners. Every
further coordinate is divided dyadically: a corner's prefix is cut into at most one
block of each size, a point lies in one block of each size, and within a block the
first coordinate decides. So there are about (points + corners) x log rows a further
coordinate, and no point meets a corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import prefix_sums

#: Bits of a block's number; its size is told above them.
_BLOCK = 48


def _blocks_of_point(x: Column, sizes: int) -> Column:
    """The blocks that hold a coordinate and that a prefix may use: those with an even number of their size."""
    levels = F.array(*[F.when(F.shiftright(x, k) % 2 == 0, F.lit(k << _BLOCK) + F.shiftright(x, k)) for k in range(sizes)])
    return F.array_compact(levels)


def _blocks_of_prefix(y: Column, sizes: int) -> Column:
    """The blocks that make up the coordinates 0 to ``y``, one for each bit of their number."""
    m = y + 1
    levels = F.array(*[F.when(F.shiftright(m, k) % 2 == 1, F.lit(k << _BLOCK) + F.shiftright(m, k) - 1) for k in range(sizes)])
    return F.array_compact(levels)


def dominated(points: DataFrame, corners: DataFrame, dims: list[str], highest: dict[str, int]) -> DataFrame:
    """(dims, below): the sum of ``n`` over the points at or below each distinct corner.

    ``points``: dims and n; ``corners``: dims; ``highest`` bounds each coordinate.
    """
    corners = corners.select(*dims).distinct()
    if not dims:
        return corners.sparkSession.range(1).select().crossJoin(points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("below")))  # one row
    first, *others = dims
    points = points.groupBy(*dims).agg(F.sum("n").alias("n"))
    nodes = [f"_{d}" for d in others]
    asked, placed = corners, points
    for d, node in zip(others, nodes, strict=True):
        sizes = (highest[d] + 2).bit_length()
        asked = asked.withColumn(node, F.explode(_blocks_of_prefix(F.col(d), sizes)))
        placed = placed.withColumn(node, F.explode(_blocks_of_point(F.col(d), sizes)))
    if nodes:
        placed = placed.join(asked.select(*nodes).distinct(), nodes, "left_semi")
    zero = F.lit(0).cast("long")
    summed = placed.groupBy(*nodes, first).agg(F.sum("n").alias("n")).select(*nodes, F.col(first).alias("_at"), F.lit(0).alias("_kind"), "n", *[F.lit(None).cast("long").alias(d) for d in dims])
    both = summed.unionByName(asked.select(*nodes, F.col(first).alias("_at"), F.lit(1).alias("_kind"), zero.alias("n"), *dims))
    upto = prefix_sums(both, "n", *nodes, F.col("_at"), F.col("_kind"), *map(F.col, others), name="_sum")
    found = upto.where("_kind = 1")
    if nodes:
        starts = upto.groupBy(*nodes).agg(F.min(F.col("_sum") - F.col("n")).alias("_start"))
        found = found.join(starts, nodes)
    else:
        found = found.withColumn("_start", zero)
    return found.groupBy(*dims).agg(F.sum(F.col("_sum") - F.col("_start")).alias("below"))
