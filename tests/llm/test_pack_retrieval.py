"""Packing's retrieval against brute-force BM25."""
import numpy as np

from tests.llm import fixtures as X
from tollgate.llm import packing


def test_all_terms_of_a_seed_score():
    """Pieces of several hundred distinct terms, all of them above the seed's heaviest in no neighbour:
    each window takes the unused pieces in order of BM25 over every shared term."""
    rng = np.random.default_rng(5)
    n, size = 24, 400
    docs = [np.concatenate([1000 + 60 * k + np.arange(60), rng.choice(900, size - 60, replace=False)]) for k in range(n)]
    at = np.arange(n + 1) * size
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000 + 60 * n)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    unused = set(range(n))
    for row in packing.fill(np.diff(at), *packing._terms(np.concatenate(docs).astype(np.uint16), at), idf, 3 * size):
        seed = row[0][0]
        unused.discard(seed)
        for p, start, length in row[1:]:
            assert (start, length) == (0, size)
            score = {u: idf[np.intersect1d(docs[seed], docs[u])].sum() for u in unused}
            assert np.isclose(score[p], max(score.values()))
            unused.discard(p)
    assert not unused


def test_neighbours_meet_across_the_whole_table(spark):
    """8 topics of 64 documents each, in shards of 64: nearly all best BM25 neighbours share the seed's
    shard, where a deal by hash lets an eighth of them meet."""
    rng = np.random.default_rng(3)
    topics = [[f"{X.prose(1000 * t + k, 1)}{t}" for k in range(40)] for t in range(8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8], 60))) for i in range(512)]
    pieces = packing.pack(X.simple(spark, rows), shard=64).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence, []).append(p.doc_id % 8)
    same = [w[0] == t for w in windows.values() for t in w[1:]]
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert np.mean(same) > 0.8


def test_equal_texts_are_dealt_on(spark):
    """One text on most rows: no shard takes them all."""
    rows = [(i, "the same words on every row" if i % 4 else X.prose(i, 30)) for i in range(800)]
    pieces = packing.pack(X.simple(spark, rows), shard=20).collect()
    shards = {}
    for p in pieces:
        shards[p.sequence >> 25] = shards.get(p.sequence >> 25, 0) + 1
    assert max(shards.values()) < 200
    assert {p.doc_id for p in pieces} == set(range(800))


def test_index_equals_plain_scores(monkeypatch):
    """Frequent terms in the matrix, all or none of them, and pieces dropped once used: the scores and the
    windows are those of a plain sum over shared terms."""
    rng = np.random.default_rng(8)
    docs = [np.unique(rng.zipf(1.4, 60) % 500) for _ in range(200)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    piece, term, tf = packing._terms(np.concatenate(docs).astype(np.uint16), at)
    weight, idf = rng.random(len(term)), rng.random(500)
    dense = np.zeros((200, 500))
    dense[piece, term] = weight
    windows = []
    for common, size in ((32, 64 << 20), (1, 64 << 20), (1000, 64 << 20), (32, 8 * 800), (32, 0)):
        monkeypatch.setattr(packing, "COMMON", common)
        monkeypatch.setattr(packing, "DENSE", size)
        index, unused = packing._Index(200, piece, term, weight, 500), np.ones(200, bool)
        assert index.matrix.nbytes <= size
        for k in range(0, 200, 10):
            unused[rng.choice(200, 10)] = False
            index.shrink(unused)
            assert set(np.flatnonzero(unused)) <= set(index.pieces)
            assert 4 * unused.sum() > 3 * len(index.pieces) or not unused.any()
            assert np.allclose(index.scores(docs[k]), dense[index.pieces][:, docs[k]].sum(axis=1), rtol=1e-4)
        windows.append(packing.fill(np.diff(at), piece, term, tf, idf, 100))
    assert all(sorted(p for w in x for p, start, _ in w if start == 0) == list(range(200)) for x in windows)


def test_index_of_empty_shard_and_of_pieces_without_shared_terms():
    none = np.zeros(0, np.int64)
    assert packing.fill(none, none, none, none, np.ones(5), 10) == []
    ids, at = np.arange(4, dtype=np.uint16), np.arange(5)
    rows = packing.fill(np.diff(at), *packing._terms(ids, at), np.ones(5), 2)
    assert [[p for p, _, _ in r] for r in rows] == [[0, 1], [2, 3]]
