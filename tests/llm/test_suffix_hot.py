"""Suffix dedup of anchors that occur very often."""
import random
from collections import Counter

import pytest

from tests.llm import fixtures as X
from tests.llm.test_dedup import plain_suffix
from tollgate.llm import suffix_dedup


def rows():
    r = random.Random(4)
    line = X.prose(70, 14)[:72]
    near = [X.prose(400 + k, 12) for k in range(5)]
    out = []
    for i in range(120):
        # the line between differing texts, and between texts that several documents share in part
        before = X.prose(500 + i, 8) + r.choice(near)[:r.randrange(60)]
        after = r.choice(near)[-r.randrange(1, 60):] + X.prose(700 + i, 8)
        out.append((i, before + line + after))
    out += [(200 + i, out[i][1]) for i in range(10)] + [(300, line * 4), (301, line * 4), (302, "a" * 400), (303, None), (304, X.prose(900, 60))]
    return out


@pytest.mark.parametrize("hot", [1, 20, 8192])
def test_hot_anchors_give_the_plain_result(spark, hot):
    pairs = rows()
    mixed = pairs[:]
    random.Random(1).shuffle(mixed)
    got = suffix_dedup.report(suffix_dedup.dedup(X.simple(spark, mixed).repartition(5), hot=hot)).collect()
    want = plain_suffix(pairs, 100)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.elements()))
    assert sum(r.n_removed > 0 for r in got) > 20


def test_no_task_takes_all_pieces_of_a_hot_anchor(spark, monkeypatch):
    """Pieces of one anchor in the column-wise construction and in the sort by hash."""
    sizes = spark.sparkContext.accumulator(0)
    most = 50

    def watched(make):
        def outer(*args):
            run = make(*args)

            def inner(table):
                if max(Counter(table.column("h").to_pylist()).values(), default=0) > most:
                    sizes.add(1)
                return run(table)
            return inner
        return outer

    for name in ("_sort_out", "_shard"):
        monkeypatch.setattr(suffix_dedup, name, watched(getattr(suffix_dedup, name)))
    line = X.prose(70, 14)[:72]
    pairs = [(i, X.prose(500 + i, 6) + line + X.prose(9000 + i, 6)) for i in range(400)]
    suffix_dedup.dedup(X.simple(spark, pairs).repartition(4), hot=most).collect()
    assert sizes.value == 0
