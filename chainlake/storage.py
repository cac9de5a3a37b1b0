"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again: the rows survive the
loss of any executor, take less disk than serialized checkpoints, and carry statistics for the planner.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode one of our own where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get(SETTING) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="chainlake-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one operator run, below the shared folder.

    save() writes and reads back; drop() deletes a table that no later plan reads. What a returned
    DataFrame still reads stays until the session ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def save(self, df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))

    def _close(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the JVM may be gone
            pass
