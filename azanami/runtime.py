"""Where intermediate tables live, and how lineage is cut.

Iterative plans write each generation as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``.  All executors share that folder, so a lost executor costs the tasks it
was running and nothing that was already finished.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one is made only if none is configured and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="azanami-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


class Stage:
    """Tables written between the steps of one plan; ``drop`` removes a generation that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, label: str = "t") -> tuple[DataFrame, str]:
        """Write df and read it back; the plan behind it is cut there."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        return self.write(df, label)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables: a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_name(base: str, taken: list[str]) -> str:
    """A column name that no column of the caller's table bears (names compare without case, as Spark does)."""
    low, name = {t.lower() for t in taken}, base
    while name.lower() in low:
        name = "_" + name
    return name
