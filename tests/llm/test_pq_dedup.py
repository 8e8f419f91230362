"""Near-duplicate vectors against brute force."""
import numpy as np
import pytest

from tests.llm import fixtures as X
from tollgate.llm import pq_dedup
from tollgate.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int, id string, key string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", 1) for i, v, lab in rows], SCHEMA)


def plain(rows, least=0.93):
    """All pairs of a label in double precision; components by union-find over rows."""
    ok = [lab is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, lab in rows]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[a] += 1
                    n[b] += 1
                    parent[find(a)] = find(b)
    first = {}
    for k, (i, _, _) in enumerate(rows):
        known = [x for x in (first.get(find(k)), i) if x is not None]
        first[find(k)] = min(known) if known else None
    return sorted(((i, n[k], first[find(k)], i == first[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in pq_dedup.groups(df, **kw).collect()), key=str)


def family(seed, base, sizes, dims, noise):
    """Random vectors, each with copies at growing distances, and their chains."""
    r, rows = np.random.default_rng(seed), []
    for k, size in enumerate(sizes):
        v = r.normal(size=dims)
        for j in range(size):
            rows.append((base + len(rows), (v + noise * (j % 7) * r.normal(size=dims)).tolist(), k % 3))
    return rows


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, [2.0, 4.0, 6.0], 0), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, -0.0], 0), (8, [1.0, None, 3.0], 0),
            (9, [1.0, nan, 3.0], 0), (10, [1.0, inf, 3.0], 0), (11, v, None), (12, v, None), (None, v, 0), (None, [9.0, -9.0, 1.0], 2),
            (13, [9.0, -9.0, 1.1], 2), (14, [1.0, 2.0, 3.0, 0.0], 0), (15, [1e300, 2e300, 3e300], 0), (16, [1e-310, 2e-310, 3e-310], 0),
            (17, [-1.0, -2.0, -3.0], 0), (18, [1.0, 0.0, -0.0], 4), (18, [1.0, -0.0, 0.0], 4), (19, v, 0), (19, v, 0), (None, None, None), (20, [5.0], 0), (21, [7.0], 0)]
    assert got(frame(spark, rows)) == plain(rows)
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None, 0)])) == [(1, 0, 1, True)]


def test_table_equals_brute_force(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    r = np.random.default_rng(4)
    rows += [(1000 + k, (np.array(v) + 0.01 * r.normal(size=len(v))).tolist(), lab) for k, (_, v, lab) in enumerate(rows[:40] * 3)]
    want = plain(rows)
    assert got(frame(spark, rows)) == want and sum(x[1] for x in want) >= 40 * 12


@pytest.mark.parametrize("dims", [5, 64])
def test_chains_in_several_lists_and_blocks(spark, monkeypatch, dims):
    """Small blocks and lists, so that links lie across lists, blocks and tasks."""
    monkeypatch.setattr(pq_dedup, "BLOCK", 32)
    monkeypatch.setattr(pq_dedup, "_margin", lambda least, dims: pq_dedup._distance(least))  # asks every list that can matter
    rows = family(dims, 0, [1] * 60 + [9] * 12 + [120], dims, 0.045)
    assert got(frame(spark, rows)) == plain(rows)


def test_recall_near_the_threshold(spark):
    """Pairs at cosines of 0.93 to 0.96 in random directions, over several lists."""
    r, rows = np.random.default_rng(8), []
    for k in range(1500):
        v = r.normal(size=64)
        v /= np.linalg.norm(v)
        w = r.normal(size=64)
        w -= (w @ v) * v
        c = 0.9301 + 0.03 * r.random()
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, (c * v + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist(), 0)]
    want, have = plain_pairs(rows), got(frame(spark, rows))
    found = sum(x[1] for x in have)
    assert found <= want and found >= 0.97 * want


def plain_pairs(rows):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return int((x @ x.T >= 0.93).sum()) - len(x)


def test_code_distances_never_refuse_a_link():
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 20))
    x[300:] = x[:300] + 0.07 * r.normal(size=(300, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    quantiser = pq_dedup.Quantiser(x[:200].astype(np.float32), 4, 20)
    cell, codes, error, asked = quantiser.index(quantiser.fill(x), 2.0)
    assert all(len(a) == 4 for a in asked)
    for c in range(4):
        far = sum(t[codes[cell == c][:, m]] for m, t in enumerate(quantiser.tables(quantiser.fill(x), c)))
        lower = np.sqrt(np.maximum(far, 0)) - error[cell == c][:, None] - pq_dedup.SLACK
        true = np.sqrt(np.maximum(2 - 2 * x[cell == c] @ x.T, 0))
        assert (lower <= true).all()
