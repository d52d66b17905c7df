"""Intermediate tables: written to the shared folder, which cuts plans and outlives executors, and deleted when done with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see; where none is set, as in tests in local mode, one of this machine."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        path = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


class Stage:
    """The intermediate tables of one piece of work."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stage-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written once; reading them again computes nothing."""
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def release(self) -> None:
        """Deletes the tables; what was read from them can no longer be."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
