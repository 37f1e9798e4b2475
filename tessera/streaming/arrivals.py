"""Queries that arrive as a stream, linked against a static set of targets, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocking
from tessera.operators.blocking import Profile
from tessera.sources import records


def link_stream(arriving: DataFrame, targets: DataFrame, profile: Profile, path: str, checkpoint: str) -> StreamingQuery:
    """Write the candidates of each batch of arriving records (RECORD's columns) to path, by batch, so that a batch that
    runs again replaces itself. targets are preprocessed."""

    def batch(df: DataFrame, number: int) -> None:
        blocking.candidates(records.preprocess(df), targets, profile).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
