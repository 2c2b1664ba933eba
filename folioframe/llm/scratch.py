"""Tables written to the shared folder that all executors see.

The folder is what `spark.checkpoint.dir` names; where that is unset an own one is made on a single machine, and
a cluster is refused. Written tables cut lineage and survive the loss of executors. What a result still reads stays
until the folder is cleared, as a checkpoint does; everything else is dropped when it has been read.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes that a writer gathers before it writes.
ROW_GROUP = 32 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder's path."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if own := spark.sparkContext.getCheckpointDir():
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """The table, written once and read from there."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark delete shuffle files that only finished steps have read."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm, jsc = self.spark._jvm, self.spark._jsc
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
