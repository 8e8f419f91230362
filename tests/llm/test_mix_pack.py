"""Mixing, packing and the pipeline against plain versions."""
import itertools
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tollgate.llm import mixing, packing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = {s: Fraction((total - sum(fixed.values())) * weight[s], sum(weight[r] for r in rest)) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, None: 5, "é": 30}, {"z": 0, "a": 7}, {}, {"only": 9}])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == plain_targets(sizes)
    assert not sizes or sum(got.values()) <= sum(sizes.values())


def test_flow_is_the_cheapest_of_all():
    """Small networks: total demand met and repetition cost against every integer flow."""
    capacity, members = {"p": 3, "q": 2, "r": 2}, {"p": ["a"], "q": ["a", "b"], "r": ["b"]}
    for da, db in itertools.product(range(0, 14, 2), repeat=2):
        got = mixing.flow(capacity, members, {"a": da, "b": db})
        cost = lambda f: sum(max(0, f[p] - k * capacity[p]) for p in f for k in (1, 2))
        best = None
        for qa in range(7):
            for qb in range(7 - qa):
                for p, r in itertools.product(range(10), range(7)):
                    if p + qa <= da and r + qb <= db:
                        f = {"p": p, "q": qa + qb, "r": r}
                        key = (-sum(f.values()), cost(f))
                        best = key if best is None else min(best, key)
        assert (-sum(got.values()), cost(got)) == best, (da, db, got)


def mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, pattern long")
    return docs, [r.asDict() for r in mixing.report(docs, **more).collect()]


def test_mix_meets_targets(spark):
    rows = [(i if i % 11 else None, X.prose(i, 5 + i * 7 % 40) if i % 13 else None, [None, "a", "b", "b", "b", "ç"][i % 6], "x", i) for i in range(600)]
    docs, got = mixed(spark, rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(X.WORD.findall(r[1] or ""))) for r in rows)
    size, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert {s: float(t) for s, t in plain_targets(dict(size)).items()} == goal
    assert all(r["source_size"] == size[r["source"]] for r in got)
    assert all(abs(taken[s] - goal[s]) <= 5 for s in goal), [(taken[s], goal[s]) for s in goal]
    again = mixed(spark, rows[::-1])[1]
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, again)) == sorted(map(key, got))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)


def test_mix_with_overlapping_sources_and_edges(spark):
    docs = X.documents(spark)
    both = mixing.mix(docs, F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("all"))).otherwise(F.array("source")))
    assert both.columns == docs.columns
    assert mixing.report(X.documents(spark, [])).count() == 0
    assert mixing.mix(X.documents(spark, [])).count() == 0
    assert all(r.taken <= 3 * r["size"] for r in mixing.report(docs).collect())
    blank = X.simple(spark, [(1, None), (2, "")])
    assert {r.taken for r in mixing.report(blank).collect()} == {0}


def test_mix_of_very_many_sources(spark):
    """More sources than the flow may have patterns: one a domain, and a hot one."""
    n = 110_000
    docs = spark.range(n + 3000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", f"case when id < {n} then concat('d', id) else 'hot' end as source")
    sizes = {f"d{i}": 1 + i % 5 for i in range(n)} | {"hot": sum(1 + i % 5 for i in range(n, n + 3000))}
    goal = mixing.targets(sizes)  # equal to the plain version on the small sizes above
    got = mixing.report(docs)
    rows = got.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(rows) == n + 3000
    assert all(r.source_size == sizes[r.source] and r.target == float(goal[r.source]) and r.taken <= 3 * r["size"] for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
    # whole documents: a source of one document misses its target by less than that document
    assert all(0 <= goal[s] - taken[s] < (sizes[s] if s != "hot" else 5) + 1 for s in sizes)


def test_patterns_apart_from_the_flow_give_what_the_flow_gives(spark):
    """Sources nobody shares are not sent to the flow; overlaps over the bound are an error."""
    lists = [["a"], ["a", "b"], ["b"], ["c"], [None], ["d", None], None, ["e"], []]
    rows = [(i, "w " * (1 + i * 7 % 9), lists[i % len(lists)]) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lists array<string>")
    narrow = mixing._narrow(docs, F.col("lists"), 0).withColumn("pattern", F.to_json("sources"))
    pats = {r.pattern: r for r in narrow.groupBy("pattern").agg(F.any_value("sources").alias("sources"), F.sum("size").alias("size")).collect()}
    sizes = defaultdict(int)
    for r in pats.values():
        for s in r.sources:
            sizes[s] += r["size"]
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    total = sum(sizes.values())
    per = mixing.goals(frame)
    goal = {r.source: (r.target, r.demand) for r in per.collect()}
    plain = mixing.targets(dict(sizes), total=total)
    assert goal == {s: (float(t), int(t)) for s, t in plain.items()}
    whole = mixing.flow({p: r["size"] for p, r in pats.items()}, {p: r.sources for p, r in pats.items()}, {s: int(t) for s, t in plain.items()})
    table = narrow.groupBy("pattern").agg(F.any_value("sources").alias("sources"), F.sum("size").alias("size"))
    got = {r.pattern: r.give for r in mixing.gives(table, per, 3, 5).collect()}
    assert got.keys() == whole.keys() and sum(got.values()) == sum(whole.values())
    assert all(got[p] == whole[p] for p in ('["c"]', '["e"]', "[]"))
    with pytest.raises(ValueError):
        mixing.gives(table, per, 3, 4)
    assert mixing.mix(docs, F.col("lists")).columns == docs.columns


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def check_packed(pieces, texts):
    """Every id in exactly one piece, windows gapless and full but for the last of each shard."""
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(tokens(t))
    seen, windows = Counter(), defaultdict(list)
    for p in pieces:
        part = np.frombuffer(p.ids, np.uint16).tolist()
        assert len(part) == p.length
        seen[p.doc_id] += p.length
        assert any(len(d) == p.doc_tokens and d[p.start:p.start + p.length] == part for d in ids[p.doc_id])
        windows[p.sequence].append((p.offset, p.length))
    assert seen == Counter({i: sum(map(len, d)) for i, d in ids.items()})
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    return [sum(n for _, n in w) for w in windows.values()]


def test_packing_round_trip(spark):
    rows = [(i, X.prose(i, 20 + i * 37 % 900)) for i in range(80)] + [(200, None), (201, ""), (202, "<|endoftext|> x"), (203, "é\U0001f600\x00"), (204, "y" * 9000)]
    pieces = packing.pack(X.simple(spark, rows), shard=40).collect()
    full = check_packed(pieces, rows)
    assert sum(n < 2048 for n in full) <= 4


def test_packing_edges(spark):
    rows = X.edge_rows()
    pieces = packing.pack(X.documents(spark)).collect()
    check_packed(pieces, [(r[0], r[1]) for r in rows])
    assert packing.pack(X.documents(spark, [])).count() == 0
    wide = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.report(packing.pack(X.documents(spark))).collect()}
    assert wide == {(p.doc_id, p.start, p.length, zlib.crc32(np.frombuffer(p.ids, np.uint16).astype("<u4").tobytes())) for p in pieces}


def test_neighbours_are_the_best_bm25_matches():
    """Whole pieces that fit: each window takes the unused pieces in order of a plain BM25."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(10 * (k % 4), 10 * (k % 4) + 12, 30) for k in range(24)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ids = np.concatenate(docs).astype(np.uint16)
    df = np.array([sum(t in d for d in docs) for t in range(64)], float)
    idf = np.log1p((24 - df + 0.5) / (df + 0.5))
    unused = set(range(24))
    for row in packing.fill(np.diff(at), *packing._terms(ids, at), idf, 90):
        seed = row[0][0]
        assert seed == min(unused)
        unused.discard(seed)

        def bm25(d):
            tf = Counter(docs[d].tolist())
            return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2) for t in set(docs[seed].tolist()) if t in tf)

        for p, start, size in row[1:]:
            assert (start, size) == (0, 30)
            assert np.isclose(bm25(p), max(bm25(u) for u in unused))
            unused.discard(p)
    assert not unused


def test_pipeline_equals_a_plain_version(spark):
    """On the smallest tables: each stage's documents against plain code on its predecessor's."""
    import corpus_pipeline
    from tests.llm.test_dedup import _rows_in_order
    from tests.llm.test_text_ops import plain_base
    from tollgate.llm.common import staged, table
    docs = table(spark, X.SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, before, X.SF))
        kept[name] = docs.collect()
        if name == "packing":
            check_packed(kept[name], [(r.doc_id, r.text) for r in before.collect()])
            continue
        assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        got = Counter((r.doc_id, r.text) for r in kept[name])
        if name == "quality rules":
            assert not any(plain_base(t)[5] for _, t in got)
            good = {r.doc_id for r in table(spark, X.SF, "labels").where("quality = 1").collect()}
            bad = {r.doc_id for r in table(spark, X.SF, "labels").where("quality = 0").collect()}
            assert not bad & {i for i, _ in got}
            assert {i for i, t in rows if i in good and not plain_base(t)[5]} <= {i for i, _ in got}
        elif name == "exact dedup":
            best = {}
            for i, t in rows:
                best[t] = max(i, best.get(t, i))
            assert got == Counter((i, t) for t, i in best.items())
        elif name == "near dedup":
            assert got == Counter(r for r, (_, _, _, k) in zip(rows, _rows_in_order(rows, 5)) if k)
        else:
            taken = {r.doc_id: r.copies for r in mixing.report(before).collect()}
            assert got == Counter({(i, t): taken[i] for i, t in rows if taken[i]})
    run = corpus_pipeline.run(spark, X.SF)
    assert Counter((r.doc_id, r.start, r.length) for r in run.collect()) == Counter((r.doc_id, r.start, r.length) for r in kept["packing"])


def test_registered_queries_cover_the_operators():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
