"""Session helpers that every part of the engine shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where neither that setting nor a checkpoint
    directory exists (tests, a laptop) is a local one made.
    """
    ctx = spark.sparkContext
    current = ctx._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="mapql-checkpoints-")
    ctx.setCheckpointDir(named)
    return ctx._jsc.sc().getCheckpointDir().get()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through the shared folder.

    Spark keeps the files while any plan refers to them, so a lost executor costs a reread only.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Intermediate tables in the shared folder, freed when their maker says so.

    A table written as Parquet has a known size, so a join broadcasts it only where it is small; it survives lost
    executors as a checkpoint does.
    """

    def __init__(self, spark: SparkSession, name: str = "tables") -> None:
        self.spark, self.base, self.count = spark, new_shared_path(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._mapql_path = path
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._mapql_path)
