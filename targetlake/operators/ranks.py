"""Ranks and running sums of rows in a global order without a global sort in one task.

Rows are dealt by range and sorted within their partitions; the result is
written once, so that later reads see the same order. What a partition has before
it is the sum over the partitions before; only one number a partition passes
through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import written


def _after_earlier(parts: DataFrame, part: Column, total: Column) -> DataFrame:
    """The rows with ``_before``: what the partitions before theirs add up to."""
    sums = sorted((r["part"], r["total"]) for r in parts.groupBy(part.alias("part")).agg(total.alias("total")).collect())
    before, upto = [], 0
    for p, n in sums:
        before.append((p, upto))
        upto += n
    starts = F.broadcast(parts.sparkSession.createDataFrame(before, "_range long, _before long"))  # a row for each range
    return parts.join(starts, part == F.col("_range")).drop("_range")


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add a long column ``name``, from 0 without gaps, in the given order; ties get ranks in any order.

    Nulls go where the order puts them; an empty table stays empty; a column called ``name`` is replaced.
    """
    sorted_rows = rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    known = _after_earlier(placed, F.shiftright("_place", 33), F.count("*"))
    return known.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_before")


def prefix_sums(rows: DataFrame, value: str, *order: Column, name: str = "upto") -> DataFrame:
    """Add the running sum of a column of whole numbers, none of them negative, up to and with each row in the given order.

    Rows that are equal in the order should be summed before, as they share a range.
    """
    sorted_rows = rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*sorted_rows.schema.fields, StructField("_upto", LongType()), StructField("_part", LongType())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)) + carry
            carry = int(sums[-1]) if len(sums) else carry
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(np.full(len(sums), part, np.int64))], names=schema.names)

    summed = written(sorted_rows.mapInArrow(running, schema), "prefix-sums")
    return _after_earlier(summed, F.col("_part"), F.max("_upto")).withColumn(name, F.col("_before") + F.col("_upto")).drop("_upto", "_part", "_before")
