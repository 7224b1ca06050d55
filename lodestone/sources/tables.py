"""Tables between the steps of a run, in the folder that the cluster shares.

The folder comes from ``spark.checkpoint.dir``; only a local session that
names none gets one of its own.  A step that several later ones read is
written once, so a lost executor never loses its only copy.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.shared.dir", named)
    return named.rstrip("/")


class Scratch:
    """Writes steps as Parquet and deletes them together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/lodestone/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete all steps; results that still read them must be written first."""
        jvm = self.spark.sparkContext._jvm
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


Keep = Callable[[DataFrame, str], DataFrame]
