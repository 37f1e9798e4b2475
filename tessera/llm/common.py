"""What the operators share: reading tables, and cutting lineage in the folder the cluster shares."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import Scratch, apart, released, shared_dir  # noqa: F401

#: Bits of a bitmap: 8 MB, whatever there is in it.
BITMAP = 26
#: Whole texts of one Arrow batch at most.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sweep(spark: SparkSession, hours: float = 24) -> int:
    """Delete the folders of operator calls that began so long ago; how many. For the end of a job, with 0, or a timer."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in (files.listStatus(root) if files.exists(root) else []) if x.getPath().getName().startswith("tessera-") and x.getModificationTime() <= (time.time() - 3600 * hours) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of df's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: By name, what this Python worker keeps, and the task that asked for it last.
_kept: dict[str, tuple[int | None, Any]] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What make() gave in this Python worker, kept from task to task."""
    task = forget(name)
    _kept[name] = task, _kept[name][1] if name in _kept else make()
    return _kept[name][1]


def forget(but: str = "") -> int | None:
    """Drop what other tasks have kept in this worker, but for one name; the task under way. Workers outlive operators and
    their memory is the executor's, so each holds the tables of one operator, not of all that ran before it."""
    at = TaskContext.get()
    task = at.taskAttemptId() if at else None
    old = [name for name, (last, _) in _kept.items() if last != task and name != but]
    for name in old:
        del _kept[name]
    if old:
        pa.default_memory_pool().release_unused()
    return task


def small_batches(spark: SparkSession) -> None:
    """From now on in this session Arrow batches have `ROWS` rows at most. The JVM and each worker hold a batch several
    times, and whole texts are large. Results are lazy, so it must last beyond the call."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= ROWS:
        spark.conf.set(most, ROWS)


def fixed_bitmap(keys: DataFrame):
    """Broadcast: the low bits of the longs `k`, 2^20 words of 64 bits whatever there are. Rows that pass it may be more
    than those in it, never fewer; whoever uses it decides the rest exactly."""
    bit = F.col("k").bitwiseAND((1 << BITMAP) - 1)
    with released(keys.sparkSession):
        words = keys.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast((k & {(1 << BITMAP) - 1}) & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << BITMAP - 6, np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def passing(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64((1 << BITMAP) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def in_bitmap(key: Column, sent) -> Column:
    """Whether the long passes."""

    @F.arrow_udf(T.BooleanType())
    def made(keys: pa.Array) -> pa.Array:
        return pa.array(passing(sent.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return made(key)
