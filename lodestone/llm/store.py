"""Tables and files in the folder that the whole cluster shares.

The folder comes from ``spark.checkpoint.dir``.  Only a local session that
names none (tests, the bench) gets one of our own.  Everything that cuts lineage is written
there, so a lost executor never loses the only copy of an intermediate result.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder named by the session; a local session that names none gets a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm_dir = spark.sparkContext.getCheckpointDir()
        named = os.path.dirname(jvm_dir) if jvm_dir else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else writes to."""
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; later plans read the table."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` made and no plan needs any more."""
    drop(df.sparkSession, df.lodestone_path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nobody holds any more; it looks for them when memory is collected.

    One round is not enough: the JVM still holds what Python lets go in the same round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, uri: str) -> None:
    """Delete a path below the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
