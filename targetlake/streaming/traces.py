"""Exact-target results of sessions while their records arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import first_target
from ..sources.traces import observed


def first_targets(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming table of each session's first hit (see ``first_target``) over the JSON lines that appear in a folder.

    The state is one row a session; write it in update or complete mode. Lines that are no objects are left out.
    """
    lines = spark.readStream.text(folder).withColumn("j", F.try_parse_json("value"))
    objects = lines.where(F.schema_of_variant("j").startswith("OBJECT"))
    return first_target(observed(objects))
