"""Spark session defaults used by the jobs, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (all inputs are timestamp_ntz in
# UTC), AQE for runtime re-planning (partition coalescing, skew-join splitting,
# broadcast conversion from *measured* sizes), and no UI server.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only below Spark's size check (10 MB default); AQE re-checks
    # with runtime statistics, so a side that grows past it falls back to a
    # sort-merge join instead of being shipped to every executor.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # Inputs live in an object store / shared folder: no node holds a split
    # locally, so do not hold tasks back waiting for locality.
    "spark.locality.wait": "0s",
    # Stream state (dedup ids for 7 days, buffered events, claim timers) can
    # outgrow the heap: keep it in RocksDB, which spills to local disk and
    # checkpoints incrementally.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tollgate", extra: dict | None = None) -> SparkSession:
    """A session with the defaults above (plus ``extra``); reuses an active one."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state, as ``spark.checkpoint.dir`` names it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(d)
    return d


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Settings sized to the input: scan splits and shuffle partitions of about
    ``target_partition_bytes`` (so a task's data fits executor memory and spills
    rarely), at least two waves of tasks over ``cores``; AQE coalesces small
    partitions at run time and splits skewed ones (a partition is skewed above
    4x the median and the target size)."""
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }
