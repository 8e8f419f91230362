"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Words and runs of punctuation, and pairs of both, are hashed into 2^`BITS` weights; a text is
the sparse vector of their square-rooted counts, scaled to length 1.  Training rows are dealt
by hash over shards of about `SHARD` rows; each shard runs FTRL-proximal over its rows in a
seeded order, and the shards' weights are averaged.  All labelled training rows are used.  A
score is the logistic function of the sparse dot product plus a bias.

Defined results: null and empty texts have no features and score the bias; labels that are
null are left out, of a document's several labels the largest counts; null doc_ids are never
labelled and not held out; repeated rows are scored each; without training rows every score
is 0.5; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bytesnp
from tollgate.llm.common import small, text_of

BITS = 18
SHARD = 8192
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 3 is 1 are never trained on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight index, value) of a slice's texts, sorted by text."""
    h, counts = bytesnp.word_hashes(data, offsets, lower=False, marks=True)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    mask = np.uint64((1 << bits) - 1)
    both = bytesnp.mix(h[pair] * np.uint64(bytesnp._BASE) + h[pair + 1])
    key = np.sort(np.concatenate([owner << bits | (h & mask).astype(np.int64), owner[pair] << bits | (both & mask).astype(np.int64)]))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    text, value = key[first] >> bits, np.sqrt(np.diff(np.append(first, len(key))))
    norm = np.sqrt(np.bincount(text, value * value, minlength=len(counts)))
    return text, key[first] & (1 << bits) - 1, value / norm[text] if len(text) else value


def ftrl(rows: list, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) after `epochs` passes over rows of (indices, values, label)."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        return -(zi - np.sign(zi) * np.minimum(np.abs(zi), L1)) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def _columns(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return bytesnp.flat(column)


def _train(bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        data, offsets = _columns(table.column("text"))
        labels, rows = table.column("label").to_numpy(), []
        for i, j in bytesnp.slices(offsets):
            text, index, value = features(data, offsets[i:j + 1], bits)
            at = np.searchsorted(text, np.arange(j - i + 1))
            for k in range(j - i):
                own = slice(at[k], at[k + 1])
                rows.append((np.append(index[own], 1 << bits), np.append(value[own], 1.0), labels[i + k]))
        w = ftrl(rows, 1 << bits)
        some = np.flatnonzero(w)
        # millionths of millionths: sums of shards are the same in any order
        return pa.table({"i": some, "w": np.round(w[some] * 1e12).astype(np.int64)})
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, shard: int = SHARD) -> np.ndarray:
    """Averaged weights of the shards, bias last: 2^bits + 1 numbers."""
    labels = (labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
              .groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id"))))
    n = labels.count()
    weights = np.zeros((1 << bits) + 1)
    shards = max(1, -(-n // shard))
    rows = docs.select("doc_id", text_of().alias("text")).join(small(labels, n, 24), "doc_id")
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text"))
    got = (rows.groupBy(F.pmod("place", F.lit(shards)).alias("shard")).applyInArrow(lambda t: _train(bits)(t), "i long, w long")
           .groupBy("i").agg(F.sum("w")).collect())  # at most 2^bits + 1 rows
    for i, w in got:
        weights[i] = w / 1e12 / shards
    return weights


def _score(weights, bits: int):
    def run(batches):
        w = weights()
        for batch in batches:
            data, offsets = bytesnp.flat(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for i, j in bytesnp.slices(offsets):
                text, index, value = features(data, offsets[i:j + 1], bits)
                out[i:j] = np.bincount(text, w[index] * value, minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2 MB at 18 bits
    bits = int(np.log2(len(weights) - 1))
    out = docs.select("doc_id", text_of().alias("text")).mapInArrow(_score(lambda: sent.value, bits), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
