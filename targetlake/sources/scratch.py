"""Written intermediate tables in the folder that the whole cluster shares.

A written table cuts the lineage: a lost executor costs a reread, not a
recomputation. The folder is the session's ``spark.checkpoint.dir``; only in
local mode, where there is one machine, a temporary one is made if it is unset.
All tables of an application are in one folder there, which goes when the driver
ends, or with :func:`clear` when the results that read it are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the cluster's shared one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    folder = f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(at):
        files.deleteOnExit(at)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it reread.

    Each call takes a folder of its own; the returned table is read lazily. What was returned by an earlier call stays as it is.
    """
    if getattr(df, "_stored", False):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = True
    return out


#: Rows in one partition at most, where :func:`dealt` is told how many there are.
ROWS = 500_000


def dealt(rows: DataFrame, number: int, key: str, most: int = ROWS) -> DataFrame:
    """About ``number`` rows by a key, in partitions of ``most`` rows; as they are if the session's shuffles have partitions enough for that."""
    parts = -(-number // most)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def clear(spark: SparkSession) -> None:
    """Remove the application's written tables; what reads them must have been written elsewhere."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
