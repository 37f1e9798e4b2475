"""Cutting lineage in the folder the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one in the warehouse, which is shared too."""
    where = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return where.rstrip("/")


def apart(df: DataFrame) -> DataFrame:
    """df, whose join is a merge join: tables that grow with the input are never sent through the driver, whatever sizes
    Spark takes for small."""
    return df.hint("merge")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that are made and run here go as each ends. Elsewhere they stay until the driver
    happens to collect its garbage, so those of an operator's steps add up. A query that is run once more makes them anew."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def single(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of what is run here have one row each."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, 1)
    try:
        yield
    finally:
        spark.conf.set(most, before)


class Scratch:
    """Tables of one operator call in the shared folder. Executors may go: every table is whole on shared storage.

    An operator drops the tables that its result does not read. Those that it does read must outlive the call, as the
    result is lazy; `sweep` deletes them later."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from a written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with released(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing needs any more."""
        for df in tables:
            path = getattr(df, "scratch_path", None)
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
