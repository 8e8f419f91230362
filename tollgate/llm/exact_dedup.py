"""Exact dedup with two Bloom passes; DataFrame functions only.

Pass 1 builds a blocked Bloom filter of the bits that the texts' hashes set at least twice.
Pass 2 probes it: a text that repeats always passes, so a row that fails is unique and goes
straight to the result.  Only rows that pass are shuffled, by SHA-256, and compared.

Defined results: null text counts as empty; nothing is normalised.  Of equal texts the row
with the largest doc_id stays; null doc_ids lose to any number; of rows that repeat that
doc_id too, exactly one stays.  An empty table gives an empty result; other columns of the
table pass through `dedup` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bloom
from tollgate.llm.common import staged, text_of


def _filter(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    blocks = bloom.geometry(docs.count())
    return bloom.build_repeated(docs, F.xxhash64(text_of(text)), blocks), blocks


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    filt, blocks = _filter(docs, text)
    seen = bloom.probe(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t")),
                       F.xxhash64("t"), filt, blocks)
    seen = staged(seen.select("doc_id", "maybe", F.unhex(F.sha2("t", 256)).alias("sha")))
    alone = seen.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    # equal rows first meet in map-side counts, so a text on a third of the rows is spread
    rows = seen.where("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("n"))
    groups = rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # joined on an expression, not on the grouping column: both sides are exchanged, so AQE can split a hot text
    key = F.hex("sha")
    met = rows.withColumn("k", key).join(groups.select(key.alias("k"), "keep_id", "group_size"), "k")
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    return alone.unionByName(met).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that pass the filter meet in one aggregate per text that keeps the largest row
    (doc_id first, then the other columns in order), combined in each task before the shuffle.
    """
    filt, blocks = _filter(docs, text)
    names = docs.columns
    order = [doc_id, *[c for c in names if c != doc_id]]
    slim = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no clash with working columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    seen = bloom.probe(slim, F.xxhash64(text_of(at[text])), filt, blocks)
    alone = seen.where(~F.col("maybe")).drop("maybe")
    best = (seen.where("maybe").groupBy(F.sha2(text_of(at[text]), 256).alias("sha"))
            .agg(F.max(F.struct(*[at[c] for c in order])).alias("r")))
    return alone.unionByName(best.select("r.*")).toDF(*names)
