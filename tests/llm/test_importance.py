"""Importance resampling and exact selection against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tollgate.llm import bytesnp, importance, selection
from tollgate.llm.common import table

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = TOKEN.findall((text or "").translate(X.LOWER))
    return w, [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f, n=10000):
    return zlib.crc32(f.encode()) % n


def plain(docs, target, n_buckets=10000):
    """The contract over Python lists of (doc_id, text)."""
    s, t = (Counter(bucket(f, n_buckets) for text in texts for f in features(text)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n_buckets) / ((s[b] + 1) * (T + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for place, (i, text) in enumerate(docs):
        words, found = features(text)
        weight = sum(gain[bucket(f, n_buckets)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words), place])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], r[5]))
    rank = {r[5]: k + 1 for k, r in enumerate(able[:5 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(r[5])) for r in rows), key=str)


def got(spark, docs, target, **kw):
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in importance.resample(docs, bench, **kw).collect()), key=str)


def test_checksums_of_word_runs():
    r = random.Random(5)
    for text in ["", "one", "Ünï cödé — x" * 9, "a" * 47 + " " + "b" * 48 + " " + "c" * 49 + " " + "d" * 5000 + " e",
                 " ".join("".join(r.choice("abñ9Z-_.") for _ in range(r.randint(1, 70))) for _ in range(400))]:
        data = np.frombuffer(text.encode(), np.uint8)
        found = Counter()
        words = 0
        for _, _, owner, b, counts in importance._features(data, np.array([0, len(data)]), 1 << 31):
            if counts is None:
                found.update(b.tolist())
            else:
                words += int(counts.sum())
        w, f = features(text)
        assert words == len(w) and found == Counter(bucket(x, 1 << 31) for x in f)


def test_long_texts_in_runs(monkeypatch):
    monkeypatch.setattr(bytesnp, "SLICE", 50)
    text = X.prose(3, 300) + " " * 300 + "w" * 400 + "... x " + X.prose(4, 50)
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(importance._features(data, np.array([0, len(data)]), 10000))
    assert len(parts) > 20
    found = Counter(x for p in parts if p[4] is None for x in p[3].tolist())
    w, f = features(text)
    assert found == Counter(map(bucket, f)) and sum(int(p[4].sum()) for p in parts if p[4] is not None) == len(w)


def test_corpus_equals_brute_force(spark):
    docs = X.corpus()
    target = [r.text for r in table(spark, X.SF, "benchmark").select("text").collect()]
    assert got(spark, X.simple(spark, docs), target) == plain(docs, target)


def test_edges_equal_brute_force(spark):
    rows = X.edge_rows() * 6  # repeated rows, ties, nulls
    docs = [(r[0], r[1]) for r in rows]
    for target in ([], [None, ""], [X.prose(2, 60), "alpha beta"]):
        assert got(spark, X.documents(spark, rows).coalesce(1), target) == plain(docs, target)
    assert got(spark, X.documents(spark, []), ["a b"]) == []


def test_long_document(spark):
    docs = [(1, X.prose(9, 400_000)), (2, "x " * 30), (3, "y" * 3_000_000)]
    assert got(spark, X.simple(spark, docs), ["x x"]) == plain(docs, ["x x"])


def test_cutoff_by_medians_of_medians(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 8)
    monkeypatch.setattr(selection, "WINNERS", 300)
    for name, value in (("equal", F.lit(7)), ("hashed", F.pmod(F.xxhash64("id"), F.lit(50)))):
        rows = spark.range(0, 3000, 1, 5).withColumn("v", value)
        keyed = rows.select("*", *selection.key(F.col("v"), F.col("id")))
        want = sorted((r.v, r.id) for r in rows.collect())
        for m in (17, 3000):
            assert selection.cutoff(keyed, m, 3000) == want[m - 1], name
    ranks = selection.ranked(keyed.where(selection.up_to(want[999])), 1000).collect()
    assert sorted((r["rank"], r.v, r.id) for r in ranks) == [(k + 1, *w) for k, w in enumerate(want[:1000])]


def test_every_round_discards_a_share():
    r = np.random.default_rng(1)
    keys = r.integers(0, 50, (500, 3))
    chunks = [k[np.lexsort(k.T[::-1])] for k in np.array_split(keys, [3, 40, 200, 201, 390])]
    medians = np.array([c[(len(c) - 1) // 2] for c in chunks])
    pivot = selection.weighted_median(medians, np.array([len(c) for c in chunks]))
    until = sum(tuple(k) <= pivot for k in keys.tolist())
    assert 500 // 4 <= until and sum(tuple(k) >= pivot for k in keys.tolist()) >= 500 // 4
    assert sum(selection._until(c, pivot) for c in chunks) == sum(list(k) <= list(pivot) for k in keys.tolist())
