"""H7: the device table as deltas of micro-batches, merged by a compaction.

The upsert is an associative merge (earliest first sighting with its platform, latest last
sighting with its ip), so a micro-batch appends only its own partial aggregate and costs O(batch).
Layout of a table's folder:

* ``batch=<number>.<run>``: the delta of a micro-batch.  A run is a stream's checkpoint; a
  retried batch replaces its own folder, another checkpoint never touches it.
* ``base/v=<number>.<id>``: a merge of everything before it, as ``data``, and in ``covers`` the
  names of the deltas it holds.  ``covers`` is written first and Spark's commit marks ``data`` last, so
  a base is either complete or not seen at all.

A reader takes the newest complete base and the complete deltas it does not cover.  Every base says
what it covers, so compactions that run at the same time, or beside the stream, lose nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.columns import classify_platform, order_key
from tollgate.sources.folders import complete, remove

COLS = ["device_id", "license_id", "platform", "first_seen", "last_seen", "last_ip"]


def device_deltas(seen: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Partial aggregate of sightings per (device, licence), mergeable later."""
    k = order_key(*order)
    return seen.groupBy("device_id", "license_id").agg(
        F.min(k).alias("first_k"), F.min("ts").alias("first_seen"),
        F.min_by(classify_platform("user_agent"), k).alias("platform"),
        F.max(k).alias("last_k"), F.max("ts").alias("last_seen"), F.max_by("ip", k).alias("last_ip"))


def combine(deltas: DataFrame) -> DataFrame:
    """One delta of any set of deltas."""
    return deltas.groupBy("device_id", "license_id").agg(
        F.min("first_k").alias("first_k"), F.min("first_seen").alias("first_seen"), F.min_by("platform", "first_k").alias("platform"),
        F.max("last_k").alias("last_k"), F.max("last_seen").alias("last_seen"), F.max_by("last_ip", "last_k").alias("last_ip"))


def merge_device_deltas(deltas: DataFrame) -> DataFrame:
    """The device table from any set of deltas (same result as upsert_devices
    over all their sightings)."""
    return combine(deltas).select("device_id", "license_id", "platform", "first_seen", "last_seen", "last_ip")


def delta_path(root: str, batch_id: int, run: str) -> str:
    """Folder of one micro-batch's device delta."""
    return f"{root}/batch={batch_id:010d}.{run}"


def append_device_deltas(root: str, compact_every: int | None = None):
    """foreachBatch function: write the batch's delta to its own folder, and merge after every
    ``compact_every``-th batch.  Re-running a batch after a failure replaces its folder (a merged
    delta is the same sightings again); the run is the query's id, which its checkpoint keeps."""
    def run(batch: DataFrame, batch_id: int):
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        device_deltas(batch).write.mode("overwrite").parquet(delta_path(root, batch_id, query))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, root)
    return run


def _state(spark: SparkSession, root: str) -> tuple[str | None, list[str]]:
    """The newest complete base, and the complete deltas that it does not cover."""
    bases = complete(spark, f"{root}/base", "v=*", "data")
    deltas = complete(spark, root, "batch=*")
    if not bases:
        return None, deltas
    covered = {r.name for r in spark.read.parquet(f"{root}/base/{bases[-1]}/covers").collect()}  # one name a micro-batch
    return bases[-1], [d for d in deltas if d not in covered]


def _parts(spark: SparkSession, root: str, base: str | None, deltas: list[str]) -> DataFrame | None:
    paths = ([f"{root}/base/{base}/data"] if base else []) + [f"{root}/{d}" for d in deltas]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else None


SCHEMA = ("device_id string, license_id long, first_k decimal(38,0), first_seen timestamp_ntz, platform string, "
          "last_k decimal(38,0), last_seen timestamp_ntz, last_ip string")


def read_devices(spark: SparkSession, root: str) -> DataFrame:
    """Current device table: the newest base merged with the deltas after it."""
    found = _parts(spark, root, *_state(spark, root))
    return merge_device_deltas(found if found is not None else spark.createDataFrame([], SCHEMA))


def compact(spark: SparkSession, root: str) -> str | None:
    """Merge the newest base and the deltas it does not cover into a new base; its name (None
    where there is nothing to merge)."""
    base, deltas = _state(spark, root)
    if not deltas:
        return None
    number = int(base[2:].split(".")[0]) + 1 if base else 1
    name = f"v={number:010d}.{uuid.uuid4().hex}"
    held = [r.name for r in spark.read.parquet(f"{root}/base/{base}/covers").collect()] if base else []
    names = spark.createDataFrame([(d,) for d in sorted({*held, *deltas})], "name string")
    names.coalesce(1).write.parquet(f"{root}/base/{name}/covers")
    combine(_parts(spark, root, base, deltas)).write.parquet(f"{root}/base/{name}/data")
    return name


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what the oldest of the `keep` newest bases replaces: older bases and the deltas it
    covers.  A reader that planned before the last `keep` compactions has to start again.

    The covered names stay in the bases, so a delta that appears again is not read twice."""
    bases = complete(spark, f"{root}/base", "v=*", "data")
    if len(bases) < keep:
        return []
    covered = {r.name for r in spark.read.parquet(f"{root}/base/{bases[-keep]}/covers").collect()}
    gone = [f"{root}/{d}" for d in complete(spark, root, "batch=*") if d in covered] + [f"{root}/base/{b}" for b in bases[:-keep]]
    remove(spark, gone)
    return gone


def stream_devices(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, compact_every: int | None = None):
    """H7: start the device-upsert stream (returns the StreamingQuery)."""
    w = stream.writeStream.foreachBatch(append_device_deltas(root, compact_every)).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
