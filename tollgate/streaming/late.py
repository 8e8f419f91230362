"""H9 with every row accounted for: counts by window of the rows that came in time, and a side
table of those that came after their window was closed.

Spark's own aggregation drops late rows without a trace.  Here a micro-batch appends three small
tables in folders of its own, which a retry replaces: its largest event time, its partial counts by
(window, labels), and its late rows.  A batch's watermark is the largest event time of the batches
before it less the lateness, as Spark has it; a row is late for a window that ends by then.  No state
store is needed, and a batch costs O(batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.sources.folders import complete


def _watermark(spark: SparkSession, root: str, lateness: str, before: int | None = None):
    """The watermark after the batches with a smaller number (all, by default); None before the first."""
    names = [n for n in complete(spark, f"{root}/seen", "batch=*") if before is None or int(n[6:]) < before]
    if not names:
        return None
    seen = spark.read.parquet(*[f"{root}/seen/{n}" for n in names])
    return seen.agg((F.max("ts") - F.expr(f"INTERVAL {lateness}")).alias("w")).first().w


def account_batch(root: str, size: str, lateness: str, labels, slide: str | None = None):
    """foreachBatch function of :func:`account_windows`."""
    def run(batch: DataFrame, n: int):
        spark, to = batch.sparkSession, f"batch={n:010d}"
        mark = _watermark(spark, root, lateness, n)
        batch = batch.persist()  # read by three writes; a lost part is read from the source again
        try:
            placed = batch.withColumn("w", F.window("ts", size, slide) if slide else F.window("ts", size))
            placed = placed.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end"),
                                         "watermark": F.lit(mark).cast("timestamp")}).drop("w")
            late = F.coalesce(F.col("window_end") <= F.col("watermark"), F.lit(False))
            placed.where(late).write.mode("overwrite").parquet(f"{root}/late/{to}")
            (placed.where(~late).groupBy("window_start", "window_end", *labels).agg(F.count(F.lit(1)).alias("requests"))
             .write.mode("overwrite").parquet(f"{root}/counts/{to}"))
            batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{root}/seen/{to}")  # last: the batch is done
        finally:
            batch.unpersist()
    return run


def account_windows(stream: DataFrame, root: str, checkpoint: str, size: str = "5 minutes", lateness: str = "10 minutes",
                    labels=("route",), slide: str | None = None):
    """H9: starts the accounting stream (`ts` a TIMESTAMP); read it with `window_counts` and `late_rows`."""
    return (stream.writeStream.foreachBatch(account_batch(root, size, lateness, list(labels), slide))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _read(spark: SparkSession, root: str, part: str) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{part}/{n}" for n in complete(spark, f"{root}/seen", "batch=*")])


def window_counts(spark: SparkSession, root: str, lateness: str, labels=("route",)) -> DataFrame:
    """On-time requests by (window, labels); `final` where the watermark has passed the window."""
    mark = F.lit(_watermark(spark, root, lateness)).cast("timestamp")
    return (_read(spark, root, "counts").groupBy("window_start", "window_end", *labels).agg(F.sum("requests").alias("requests"))
            .withColumn("final", F.col("window_end") <= mark))


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """The late rows with all their columns, their window and the watermark they missed."""
    return _read(spark, root, "late")
