"""Written tables in the folder that all executors share; they cut the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine in local mode; elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trellis-")
        gone_at_exit(spark, folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _where(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The driver removes ``path`` when it ends."""
    at, files = _where(spark, path)
    files.deleteOnExit(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _where(spark, path)
    files.delete(at, True)


class Rounds:
    """Tables of one iterative operator, each written once and gone when the driver ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        gone_at_exit(spark, self.root)

    def counted(self, df: DataFrame, which=None) -> tuple[DataFrame, int]:
        """The written rows, and how many of them ``which`` holds for (all without it); one job."""
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        df.observe(seen, F.sum(F.lit(1) if which is None else which.cast("int")).alias("n")).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), int(seen.get.get("n") or 0)

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        """The written rows; a reader of some values of the columns ``by`` reads these rows alone."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """The rows as one table in the shared folder."""
    return Rounds(df.sparkSession, "graph").write(df)


def dealt(df: DataFrame) -> DataFrame:
    """Rows that grow with the graph, to be joined by a shuffle: the size of a compressed file tells too little of what a
    broadcast of its rows takes in the driver."""
    return df.hint("merge")
