"""Written intermediate tables of the operators; see :mod:`targetlake.sources.scratch`."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.scratch import clear, shared_dir, written

__all__ = ["clear", "partitions", "shared_dir", "written"]


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
