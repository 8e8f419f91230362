"""Helpers shared by the operators: table reads, words, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.session import checkpoint_dir

#: White space between words, as a regex class body (space and \t \n \v \f \r).
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest side that is sent to every executor, in bytes as estimated by the caller.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """`[^\\x20\\x09-\\x0D]+` matches, in order, as an array."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which driver and executors share; an error
    where that is unset."""
    root = checkpoint_dir(spark)
    return f"{root.rstrip('/')}/tollgate-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: later jobs reuse the
    rows, a lost executor only rereads files, and the lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if `rows * row_bytes` stays under the bound; else as it is,
    which leaves the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of at most 2,000 rows instead of 10,000: a
    batch is held by the JVM and, in a few copies, by the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def by_shard(df: DataFrame, h: Column, shards: int):
    """`df` grouped in `shards` groups by the hash `h`, one group a task up to 20,000 tasks: the
    groups' work, not their bytes, is what AQE should not put together again."""
    return df.withColumn("shard", F.pmod(h, F.lit(shards))).repartition(min(shards, 20_000), "shard").groupBy("shard")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once a row, also where nested lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)
