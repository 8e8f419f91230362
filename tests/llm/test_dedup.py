"""Exact dedup, MinHash groups and suffix dedup against brute force."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tollgate.llm import bloom, bytesnp, exact_dedup, minhash_dedup, suffix_dedup


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.col("id").alias("k"))
    blocks = bloom.geometry(5000)
    filt = bloom.build(keys, F.xxhash64("k"), blocks)
    out = bloom.probe(spark.range(20000).select(F.col("id").alias("k")), F.xxhash64("k"), filt, blocks)
    got = {r.k for r in out.where("maybe").collect()}
    assert set(range(5000)) <= got and len(got) < 5000 + 0.05 * 15000


def plain_exact(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stayed = False
        for i in ids:
            kept = i == keep and not stayed
            stayed |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def test_exact_report_on_edges(spark):
    rows = X.edge_rows()
    got = Counter(tuple(r) for r in exact_dedup.report(X.documents(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == plain_exact([(r[0], r[1]) for r in rows])


def test_exact_dedup_keeps_one_row_of_each_text_with_its_columns(spark):
    docs = X.documents(spark)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r.text or "" for r in got) == sorted({r[1] or "" for r in X.edge_rows()})
    best = {t: keep for (_, keep, _, kept, t) in plain_exact([(r[0], r[1]) for r in X.edge_rows()]) if kept}
    assert {hashlib.sha256((r.text or "").encode()).hexdigest(): r.doc_id for r in got} == best


def test_empty_tables(spark):
    none = X.documents(spark, [])
    assert exact_dedup.report(none).count() == 0
    assert exact_dedup.dedup(none).count() == 0
    assert minhash_dedup.groups(none).count() == 0
    assert minhash_dedup.dedup(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0


def shingle_sets(pairs, k):
    out = []
    for i, t in pairs:
        w = X.WORD.findall((t or "").translate(X.LOWER))
        out.append((i, frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def plain_groups(pairs, k, least=80):
    sets = shingle_sets(pairs, k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= least * len(x | y):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for a, (i, s) in enumerate(sets):
        ids[find(a)].append(i)
    out = []
    for a, (i, s) in enumerate(sets):
        known = [j for j in ids[find(a)] if j is not None]
        c = min(known) if known and s else i
        out.append((i, len(s), c, i == c))
    return Counter(out)


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_groups_on_edges(spark, k):
    pairs = [(r[0], r[1]) for r in X.edge_rows()]
    got = Counter(tuple(r) for r in minhash_dedup.groups(X.documents(spark), k=k).collect())
    assert got == plain_groups(pairs, k)


def test_minhash_groups_with_chains_and_hot_groups(spark):
    r, pairs = random.Random(5), []
    for g in range(12):  # chains: each is near the one before, the ends are far apart
        words = X.prose(100 + g, 60 + 10 * g).split()
        for step in range(12):
            pairs.append((len(pairs), " ".join(words)))
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = f"new{g}x{step}x{r.random()}"
    base = X.prose(999, 90).split()
    for c in range(300):  # one hot group of near copies, some of them only similar to a few
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 8, 16])):
            words[r.randrange(len(words))] = f"h{c}x{r.random()}"
        pairs.append((len(pairs), " ".join(words)))
    got = Counter(tuple(x) for x in minhash_dedup.groups(X.simple(spark, pairs), k=2).collect())
    assert got == plain_groups(pairs, 2)


def test_minhash_dedup_keeps_one_document_of_each_group(spark):
    docs = X.documents(spark)
    out = minhash_dedup.dedup(docs, k=2)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    pairs = [(r[0], r[1]) for r in X.edge_rows()]
    # rows equal in id and text go together; null ids stay only where no number is in their group
    keep = Counter()
    for (i, t), (gi, n, c, kept) in zip(pairs, _rows_in_order(pairs, 2)):
        if not n or (kept and not (i is None and c is not None)):
            keep[(i, t)] += 1
    assert got == keep


def _rows_in_order(pairs, k):
    sets = shingle_sets(pairs, k)
    out = []
    for a, (i, s) in enumerate(sets):
        group = _reach(sets, a)
        known = [sets[b][0] for b in group if sets[b][0] is not None]
        c = min(known) if known and s else i
        out.append((i, len(s), c, i == c))
    return out


def _reach(sets, a):
    seen, todo = {a}, [a]
    while todo:
        x = sets[todo.pop()][1]
        for b, (_, y) in enumerate(sets):
            if b not in seen and x and y and 100 * len(x & y) >= 80 * len(x | y):
                seen.add(b)
                todo.append(b)
    return seen


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    element = np.concatenate([common, a, common, b])
    owner = np.repeat([0, 1], 900)
    sig = minhash_dedup.signatures(owner, element, 2)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12
    tiny = minhash_dedup.signatures(np.zeros(3, int), common[:3], 2)
    assert (tiny[0] >> np.uint64(32)).max() < 128 and tiny[1].min() == np.iinfo(np.uint64).max


def plain_suffix(pairs, length):
    """`pairs` in corpus order."""
    seen, out = set(), []
    for i, t in pairs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            s = raw[k:k + length]
            if s in seen:
                gone[k:k + length] = True
            seen.add(s)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def suffix_rows(spark, pairs, length=100):
    return Counter(tuple(r) for r in suffix_dedup.report(suffix_dedup.dedup(X.simple(spark, pairs), length)).collect())


def test_suffix_dedup_passages_edits_and_runs(spark):
    r = random.Random(9)
    passage, line = X.prose(50, 60), X.prose(51, 20) + "\n"
    pairs = []
    for i in range(60):
        t = X.prose(200 + i, r.randint(5, 60))
        if i % 3 == 0:
            t += passage[r.randrange(40):len(passage) - r.randrange(40)] + X.prose(300 + i, 10)
        if i % 4 == 1:
            t = line * r.randint(1, 3) + t
        if i % 10 == 7:
            t = pairs[r.randrange(len(pairs))][1]
        if i % 10 == 8:
            t = pairs[r.randrange(len(pairs))][1].replace("ta", "to", 1)
        pairs.append((i, t))
    pairs += [(100, "a" * 700), (101, "ab" * 300), (102, None), (103, "é" * 140 + "a" * 120), (104, "x" * 99), (105, "x" * 100), (106, "x" * 100)]
    shuffled = pairs[:]
    r.shuffle(shuffled)
    assert suffix_rows(spark, shuffled) == plain_suffix(pairs, 100)


def test_suffix_dedup_counts_equal_rows_once(spark):
    t, u = X.prose(60, 80), X.prose(61, 50)
    got = suffix_rows(spark, [(1, t), (1, t), (None, u), (2, u + "q")])
    want = plain_suffix([(None, u), (1, t), (2, u + "q")], 100)
    want[next(k for k in want if k[0] == 1)] = 2
    assert got == want


def test_collection_orders_suffixes_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(60):
        strings = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        at = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        text = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
        string, size, lcp = suffix_dedup.collection(text, at)
        order = sorted((list(s[len(s) - n:]) + [i - 1000], i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
        assert list(zip(string.tolist(), size.tolist())) == [(i, n) for _, i, n in order]
        for k in range(1, len(order)):
            a, b = order[k - 1][0][:-1], order[k][0][:-1]
            same = 0
            while same < min(len(a), len(b)) and a[same] == b[same]:
                same += 1
            assert lcp[k] == same


def test_suffix_dedup_of_the_smallest_table(spark):
    pairs = X.corpus()
    assert suffix_rows(spark, pairs) == plain_suffix(pairs, 100)


def test_minhash_of_the_smallest_table(spark):
    pairs = X.corpus()
    assert Counter(tuple(r) for r in minhash_dedup.groups(X.simple(spark, pairs), k=2).collect()) == plain_groups(pairs, 2)


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = (X.prose(1, 900) + " " * 200 + "w" * 700 + "\n" + X.prose(2, 30) + "é" * 64).encode()
    data = np.frombuffer(b"xy " + text + b" z", np.uint8)
    want, counts = bytesnp.word_hashes(data, np.array([3, 3 + len(text)]))
    for size in (64, 100, 333):
        monkeypatch.setattr(bytesnp, "SLICE", size)
        assert bytesnp.long_word_hashes(data, 3, 3 + len(text)).tolist() == want.tolist()
    for k in (1, 2, 5):
        one = bytesnp.shingles(want, counts, k)
        two = bytesnp.shingles(np.concatenate([want, want[:9]]), np.array([len(want), 9]), k)
        assert sorted(one[1].tolist()) == sorted(two[1][two[0] == 0].tolist())


def test_signatures_do_not_depend_on_runs(monkeypatch):
    r = np.random.default_rng(3)
    sizes = [1, 5, 700, 0, 130, 4000, 2]
    owner, element = np.repeat(np.arange(len(sizes)), sizes), r.integers(0, 1 << 63, sum(sizes)).astype(np.uint64)
    want = minhash_dedup.signatures(owner, element, len(sizes))
    for run in (1, 7, 128, 1000):
        monkeypatch.setattr(minhash_dedup, "RUN", run)
        assert (minhash_dedup.signatures(owner, element, len(sizes)) == want).all()
    for i, lo, hi in ((2, 6, 706), (4, 706, 836)):  # plain version: each element's whole permutation
        best = {}
        for x in element[lo:hi].tolist():
            deal = list(range(128))
            for j, v in enumerate(bytesnp.mix(np.array([x ^ ((j + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1) for j in range(128)], np.uint64)).tolist()):
                k = j + (((v & 0xFFFFFFFF) * (128 - j)) >> 32)
                slot, deal[k] = deal[k], deal[j]
                best[slot] = min(best.get(slot, 1 << 64), (v >> 32) | j << 32)
        assert [best[slot] for slot in range(128)] == want[i].tolist()


def test_text_of_50_mb_in_bounded_memory():
    """Set and signature of one text: memory grows with its set, not by a row of slots an element."""
    import tracemalloc

    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(97, 123, (6_250_000, 7), np.uint8), np.full((6_250_000, 1), 32, np.uint8)], axis=1).ravel()
    column = pa.array([text.tobytes().decode()])
    tracemalloc.start()
    (made,) = minhash_dedup._fingerprints(2, 128, 4)([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), column], names=["doc_id", "tie", "text"])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.column("n").to_pylist()[0] > 6_200_000 and peak < 500 << 20


def test_long_near_copies(spark):
    """Texts of several MB, over more runs than one; a copy with some words changed is linked."""
    text = X.prose(7, 300_000)
    rows = [(1, text), (2, text[:-30_000] + "tail " * 300), (3, "alpha beta gamma delta epsilon zeta")]
    got = {x.doc_id: (x.component_id, x.n_shingles) for x in minhash_dedup.groups(X.simple(spark, rows), k=2).collect()}
    assert got[2][0] == 1 and got[1][0] == 1 and got[3] == (3, 5)
