"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder if the session runs in one
    process; on a cluster, whose machines don't share such a folder, it is an error."""
    found = spark.conf.get(SHARED_DIR, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SHARED_DIR} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set(SHARED_DIR, found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back, which cuts the lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


#: Tables of up to so much are sent to all workers in jobs of many rounds. They pass through the driver, in each round anew.
ROUND_BROADCAST = "512k"
THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def few_broadcasts(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``job`` of a table, whose stored tables are made with only the smallest of them sent to all workers by Spark."""

    @wraps(job)
    def run(df: DataFrame, *args, **given) -> DataFrame:
        conf = df.sparkSession.conf
        before = [conf.get(x, None) for x in THRESHOLDS]
        for name in THRESHOLDS:
            conf.set(name, ROUND_BROADCAST)
        try:
            return job(df, *args, **given)
        finally:
            for name, value in zip(THRESHOLDS, before, strict=True):
                conf.unset(name) if value is None else conf.set(name, value)

    return run


def spread(df: DataFrame, *keys: str, rows: int = 2000) -> DataFrame:
    """``df`` dealt to a task per so many rows. For rows that are dear to work on: a table of small rows lies in a few
    splits however many rows it has, and partitions that Spark sizes by bytes are as few."""
    return df.repartition(df.count() // rows + 1, *keys)


class Levels:
    """A table that grows by levels, each stored once as a folder of it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_path(spark, name)
        self.stored_at, self.schema = self.path, None

    @property
    def sparkSession(self) -> SparkSession:
        return self.spark

    def add(self, df: DataFrame, level: int) -> DataFrame:
        """Store a level; returns it as stored."""
        self.schema = df.schema
        path = f"{self.path}/level={level}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """The levels so far."""
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path).select(*self.schema.names)


def discard(*stored: DataFrame | Levels) -> None:
    """Delete tables of ``materialize`` and levels that nothing will read any more, as those of an earlier round."""
    for df in stored:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
