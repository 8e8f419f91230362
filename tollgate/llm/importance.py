"""Importance resampling towards a target: n-gram bucket gains, Gumbel scores, exact selection.

1. One pass over each table counts its features (runs of 1 to 3 words) by CRC-32 bucket; a task
   sends one row per bucket.
2. The buckets' gains are one array of `buckets` integers.  A second pass over the documents adds
   up the gains of a document's features by array lookups, and a Gumbel draw from its id.
3. `selection.cutoff` finds the key of the last document drawn by weighted medians of medians;
   only the winners are sorted and numbered.

CRC-32 values are computed for whole slices of texts: a word's by bytes, column by column, and a
run's from its words' (appending k zero bytes is a linear map, kept as tables).

Defined results: a null or empty text has no features and weight 0; a null doc_id is drawn as an
empty decimal and comes last among equal scores; rows that tie in score and doc_id are ordered by
n_features, then by their place in the table; repeated rows are rows of their own; an empty table
gives an empty result, an empty target counts as T = 0; texts of any length are read in runs of
about `bytesnp.SLICE` bytes; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bytesnp, selection
from tollgate.llm.common import staged, text_of

BUCKETS, RUN, MIN_WORDS, PER_CENT, SEED = 10_000, 3, 20, 5, 42
_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reversed
_LONG = 48  # bytes from which a word's checksum is taken by itself


@lru_cache
def _tables():
    """Lower-cased bytes, word bytes, the byte table of CRC-32, and the tables that append 0 to
    255 zero bytes and 256 * 2^j of them: [length][byte of the checksum][its value]."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
    zeros = np.empty((257, 4, 256), np.uint32)
    zeros[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(256):
        zeros[n + 1] = step[zeros[n] & 255] ^ (zeros[n] >> 8)
    doubled = [zeros[256]]
    while len(doubled) < 24:  # up to 2^31 bytes
        doubled.append(_through(doubled[-1], doubled[-1]))
    return lower, word, step, np.ascontiguousarray(zeros[:256]), doubled


def _through(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]


def _append_zeros(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums `c` after n more zero bytes, as far as the linear part goes."""
    _, _, _, zeros, doubled = _tables()
    flat, base = zeros.reshape(-1), (n & 255) * 1024
    out = flat[base + (c & 255)] ^ flat[base + 256 + ((c >> 8) & 255)] ^ flat[base + 512 + ((c >> 16) & 255)] ^ flat[base + 768 + (c >> 24)]
    more, j = n >> 8, 0
    while more.any():
        odd = np.flatnonzero(more & 1)
        out[odd] = _through(doubled[j], out[odd])
        more, j = more >> 1, j + 1
    return out


def _word_sums(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC-32 of each word low[s:e]."""
    step, size = _tables()[2], e - s
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    by_size, begin = size[order], s[order]
    reg = np.full(len(s), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-by_size, -_LONG, "left"))  # the words before are long
    live = len(s)
    for j in range(_LONG):
        live = int(np.searchsorted(-by_size, -j, "left"))  # words of more than j bytes
        if live <= first:
            break
        r = reg[first:live]
        reg[first:live] = step[(r ^ low[begin[first:live] + j]) & 255] ^ (r >> 8)
    out = np.empty(len(s), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    for i in order[:first]:
        out[i] = zlib.crc32(low[s[i]:e[i]])
    return out


def _words(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words of the texts at `at` of lower-cased bytes."""
    kind = _tables()[1][low]
    edge = np.ones(len(low) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True  # a word never crosses texts
    runs = np.flatnonzero(edge)
    inside = kind[runs[:-1]] if len(runs) > 1 else np.zeros(0, bool)
    return runs[:-1][inside], runs[1:][inside]


def _buckets(low: np.ndarray, s: np.ndarray, e: np.ndarray, place: np.ndarray, skip: int, buckets: int):
    """(index of the last word, bucket) of all runs of 1 to RUN words.  `place` is a word's place in
    its text; runs that end in the first `skip` words of a text are left out."""
    if not len(s):
        return
    c, size = _word_sums(low, s, e), e - s
    new = np.flatnonzero(place >= skip)
    yield new, c[new] % np.uint32(buckets)
    spaced = _append_zeros(np.full(len(c), zlib.crc32(b" "), np.uint32), size) ^ c  # of " word"
    run = c
    for k in range(1, RUN):
        longer = np.zeros_like(c)
        longer[1:] = _append_zeros(run[:-1], size[1:] + 1) ^ spaced[1:]
        run = longer
        has = new[place[new] >= k]
        yield has, run[has] % np.uint32(buckets)


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """(first row, rows, owners, buckets, words by row) in parts.  A long text comes in several,
    cut between words, each after the RUN - 1 words before it."""
    lower, word = _tables()[:2]
    for i, j in bytesnp.slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * bytesnp.SLICE or j - i > 1:
            low, at = lower[data[lo:hi]], offsets[i:j + 1] - lo
            s, e = _words(low, at) if hi > lo else (np.zeros(0, np.int64),) * 2
            before = np.searchsorted(s, at)
            counts = np.diff(before)
            owner = np.repeat(np.arange(j - i), counts)
            place = np.arange(len(s)) - before[:-1][owner]
            for last, b in _buckets(low, s, e, place, 0, buckets):
                yield i, j, owner[last], b, None
            yield i, j, None, None, counts
            continue
        before, p = [], lo
        while p < hi:
            q = min(p + bytesnp.SLICE, hi)
            while q < hi and word[data[q]]:
                ahead = np.flatnonzero(~word[data[q:q + bytesnp.SLICE]])
                q = q + int(ahead[0]) if len(ahead) else min(q + bytesnp.SLICE, hi)
            held = b"".join(w + b" " for w in before)
            low = np.concatenate([np.frombuffer(held, np.uint8), lower[data[p:q]]])
            s, e = _words(low, np.array([0, len(low)]))
            for last, b in _buckets(low, s, e, np.arange(len(s)), len(before), buckets):
                yield i, j, np.zeros(len(last), np.int64), b, None
            yield i, j, None, None, np.array([len(s) - len(before)])
            before, p = [low[x:y].tobytes() for x, y in zip(s[-(RUN - 1):], e[-(RUN - 1):])], q


def _count(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, owner, b, _ in _features(*bytesnp.flat(batch.column("text")), buckets):
                if owner is not None:
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of the whole texts by bucket: an array of that length."""
    rows = (texts.select(text_of().alias("text")).mapInArrow(_count(buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _draw(seed: int, doc_id) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains: np.ndarray, seed: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for i, j, owner, b, counts in _features(*bytesnp.flat(batch.column("text")), len(gains)):
                if counts is not None:
                    words[i:j] += counts
                else:
                    features[i:j] += np.bincount(owner, minlength=j - i)
                    weight[i:j] += np.bincount(owner, gains[b], minlength=j - i).astype(np.int64)  # whole numbers under 2^53
            draws = np.array([_draw(seed, x) for x in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, weight, weight + draws))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def score(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(_score(gains, seed), "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, and the rank of the documents drawn (else null).

    Of the documents with at least `min_words` words, `per_cent` of a hundred are drawn, the
    highest scores first."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = staged(score(docs, gains, seed).withColumn("place", F.monotonically_increasing_id()))
    keyed = rows.select("*", *selection.key(-F.col("score"), F.isnull("doc_id").cast("long"), F.coalesce("doc_id", F.lit(0)),
                                            -F.col("n_features"), F.col("place")))
    able = F.col("n_words") >= min_words
    n = rows.where(able).count()
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    drawn = n * per_cent // 100
    if not drawn:
        return rows.select(*out, none)
    last = selection.cutoff(keyed.where(able), drawn, n)
    won = able & selection.up_to(last)
    return keyed.where(~won).select(*out, none).unionByName(selection.ranked(keyed.where(won), drawn).select(*out, "rank"))
