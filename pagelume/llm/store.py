"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system: one without a scheme lies in the cluster's default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset: a temporary folder in local mode (tests), else an error, since
    executors wouldn't see a folder of the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Written tables under one fresh folder. A table cuts the lineage: a lost executor costs a reread, no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = qualified(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        self.spark._jvm.System.gc()  # Spark removes the shuffle files of finished jobs once the driver has collected them
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            where = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            where.getFileSystem(conf).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
