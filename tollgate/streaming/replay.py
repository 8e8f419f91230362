"""Replays a table as a stream: its slices arrive one after the other, and the query runs from its
checkpoint after each, as a scheduled ``availableNow`` job would."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.session import checkpoint_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for streams: RocksDB state, and as many state
    partitions as there are cores.  The caller's settings stay as they are."""
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    s.conf.set("spark.sql.shuffle.partitions", str(max(1, spark.sparkContext.defaultParallelism)))
    return s


def replay(rows: DataFrame, slice_col: str, start: Callable, folder: str, slices: list, between: Callable | None = None) -> None:
    """Writes each of the ``slices`` of ``rows`` in turn to ``folder``/in and, after each, runs
    ``start(stream, checkpoint)`` to its end.  ``between(i)`` runs after the i-th."""
    session = stream_session(rows.sparkSession)
    data = rows.drop(slice_col)
    for i, s in enumerate(slices):
        rows.where(F.col(slice_col) == F.lit(s)).drop(slice_col).write.parquet(f"{folder}/in/slice={i:04d}")
        stream = session.readStream.schema(data.schema).parquet(f"{folder}/in/slice=*")
        query = start(stream, f"{folder}/checkpoint")
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        if between:
            between(i)


def to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a stream into Parquet files: appended rows, or with ``update`` each micro-batch's
    changed rows in a folder of its own, which a retried batch replaces."""
    if mode == "append":
        w = df.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        w = df.writeStream.outputMode("update").foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n:010d}"))
    return w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
