"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder. Only a local master may go without one: it gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


class Written:
    """A data frame as a table: computed once, and no lineage to repeat when executors are lost."""

    def __init__(self, df: DataFrame):
        self.path, spark = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}", df.sparkSession
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def delete(self) -> None:
        """Deletes the files; nothing may read the table any more."""
        spark = self.df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
