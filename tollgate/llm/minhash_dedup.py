"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, components.

A document's set is its distinct shingles of `k` lower-cased words.  SuperMinHash deals each
element's ranks 0, 1, 2, ... to the signature's slots by a random permutation of its own, so
an element never wins two slots at the same rank (lower variance than independent hashes),
and stops once no later rank can win (a few rounds for sets larger than the signature).
128 slots in 32 bands of 4: two sets of similarity 0.8 share no band with probability
(1 - 0.8^4)^32 = 5e-8.

1. One pass over the texts writes per document its set's size, 128-bit key and bands.  Equal
   sets become one node.
2. Nodes that share a band meet: first each with the smallest and the largest of the bucket.
   Pairs whose signatures agree in under 60 % of the slots (5.7 standard deviations under
   0.8) are refused; the rest is confirmed on full sets, which are made anew only for nodes
   in shared buckets.
3. Confirmed links are joined into components (large-star / small-star rounds).
4. Buckets that still hold several components are searched further.  Their members meet in
   families, one per smallest root; members outside that root probe an inverted index of the
   family's sets, in blocks of at most `FAMILY` rows and probes, and report one link to each
   other component they reach.  So no link between members of one bucket is lost, and no
   pairs but links leave a task.

Defined results: null and empty texts have an empty set, stand alone and are kept; a text
with fewer than `k` words is one shingle; a text of any length is read in runs of about
`bytesnp.SLICE` bytes, and its set is held whole; equal sets are linked; null doc_ids take part and
never name a component that has a number; repeated rows are rows of their component; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bloom, bytesnp
from tollgate.llm.common import by_shard, small_batches, staged, text_of

SLOTS, ROWS = 128, 4
LEAST = 80  # per cent of the union
AGREE = 0.6
RUN = 1 << 15  # elements whose permutations are held at once
FAMILY = 1024


def signatures(owner: np.ndarray, element: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: n x slots values, rank in the high and a random number in the low 32 bits.

    Elements (sorted by owner) are taken in runs of `RUN`, so the permutations of a set of any size
    fit; minima combine, and a later run stops as soon as its sets' slots are all won."""
    best = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(element), RUN):
        own = owner[lo:lo + RUN]
        first, last = int(own[0]), int(own[-1]) + 1
        _deal(own - first, element[lo:lo + RUN], best[first:last])
    return best


def _deal(owner: np.ndarray, element: np.ndarray, best: np.ndarray) -> None:
    """Lowers `best` (a row per owner) by the ranks of one run of elements."""
    slots, flat = best.shape[1], best.reshape(-1)
    deal = np.empty((len(element), slots), np.uint8)
    deal[:] = np.arange(slots, dtype=np.uint8)
    live, own = np.arange(len(element)), owner
    for j in range(slots):
        keep = ((best.max(axis=1) >> np.uint64(32)) >= j)[own]
        if not keep.all():
            live, own = live[keep], own[keep]
        if not len(live):
            break
        x = bytesnp.mix(element[live] ^ np.uint64((j + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        slot = deal[live, k]
        deal[live, k] = deal[live, j]  # the permutation's next swap
        np.minimum.at(flat, own * slots + slot, (x >> np.uint64(32)) | np.uint64(j << 32))


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    acc = np.zeros((len(sig), sig.shape[1] // rows), np.uint64) + np.arange(sig.shape[1] // rows, dtype=np.uint64)
    for r in range(rows):
        acc = bytesnp.mix(acc * np.uint64(bytesnp._BASE) + sig[:, r::rows])
    return acc


def _keys(owner: np.ndarray, element: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set's elements."""
    out = np.zeros((len(sizes), 2), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        at = (np.cumsum(sizes) - sizes)[some]
        for i, c in enumerate((0x1234567, 0x89ABCDEF01)):
            out[some, i] = np.add.reduceat(bytesnp.mix(element ^ np.uint64(c)), at)
    return out


def _binary(rows: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    made = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return made if none is None else pa.array(made.to_pylist(), pa.binary(), mask=none)


def _sets(column: pa.Array, k: int):
    data, offsets = bytesnp.flat(column)
    for i, j in bytesnp.slices(offsets):
        if j - i == 1 and offsets[j] - offsets[i] > bytesnp.SLICE:
            h = bytesnp.long_word_hashes(data, int(offsets[i]), int(offsets[j]))
            counts = np.array([len(h)])
        else:
            h, counts = bytesnp.word_hashes(data, offsets[i:j + 1])
        yield i, j, *bytesnp.shingles(h, counts, k)


def _fingerprints(k: int, slots: int, rows: int):
    def run(batches):
        for batch in batches:
            for i, j, owner, element, sizes in _sets(batch.column("text"), k):
                sig = signatures(owner, element, j - i, slots)
                low = _binary((sig & np.uint64(255)).astype(np.uint8))
                bands = _bands(sig, rows).view(np.int64)
                at = np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("tie").slice(i, j - i), pa.array(sizes.astype(np.int64)),
                     _binary(_keys(owner, element, sizes)), low,
                     pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel()))],
                    names=["doc_id", "tie", "n", "key", "sig", "bands"])
    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            for i, j, owner, element, sizes in _sets(batch.column("text"), k):
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_binary(_keys(owner, element, sizes)),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(element.view(np.int64)))], names=["key", "elements"])
    return run


def _agree(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (bytesnp.flat(batch.column(c)) for c in ("sa", "sb"))
                a, b = (d[o[0]:o[-1]].reshape(batch.num_rows, -1) for d, o in (a, b))
                batch = batch.filter(pa.array((a == b).mean(axis=1) >= least))
            yield batch.select(["a", "b"])
    return run


def _family_links(least: int):
    """Links of each (family, r, p): probes against an inverted index of the rows' full sets."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("family", "r", "p", "asks", "id")])
        ids, roots, asks = (table.column(c).to_numpy() for c in ("id", "root", "asks"))
        lists = table.column("elements").combine_chunks()
        lists = lists if not isinstance(lists, pa.ChunkedArray) else pa.concat_arrays(lists.chunks)
        at, element = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        key = np.stack([table.column(c).to_numpy() for c in ("family", "r", "p")])
        edges = np.flatnonzero(np.concatenate([[True], np.any(key[:, 1:] != key[:, :-1], axis=0), [True]]))
        found = set()
        for lo, hi in zip(edges, edges[1:]):
            mid = lo + int((~asks[lo:hi]).sum())  # rows first, then probes
            sizes = np.diff(at[lo:mid + 1])
            posted = np.repeat(np.arange(mid - lo), sizes)
            order = np.argsort(element[at[lo]:at[mid]], kind="stable")
            sorted_, posted = element[at[lo]:at[mid]][order], posted[order]
            for x in range(mid, hi):
                own = element[at[x]:at[x + 1]]
                a, b = np.searchsorted(sorted_, own, "left"), np.searchsorted(sorted_, own, "right")
                n = b - a
                hits = posted[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                shared = np.bincount(hits, minlength=mid - lo)
                like = np.flatnonzero((100 * shared >= least * (len(own) + sizes - shared)) & (roots[lo:mid] != roots[x]))
                for y in like[np.unique(roots[lo:mid][like], return_index=True)[1]]:
                    found.add((min(ids[x], ids[lo + y]), max(ids[x], ids[lo + y])))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id: root is the smallest id of its component.

    Large-star and small-star rounds: each id hands its larger, then its smaller neighbours
    to the smallest it sees.  Every round is one table in the shared folder."""
    edges, before = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.where("m < u").select("u", F.col("m").alias("v"))
        star = large.unionByName(kept).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def _rows(docs: DataFrame, k: int, least: int, slots: int, rows: int) -> DataFrame:
    """One row per document: doc_id, tie (hash of the text), n_shingles, and `first`, the
    (doc_id, tie) of its component that stays; null for empty sets."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_of().alias("text"))
    prints = staged(texts.withColumn("tie", F.xxhash64("text")).mapInArrow(
        _fingerprints(k, slots, rows), "doc_id long, tie long, n long, key binary, sig binary, bands array<long>"))
    nodes = staged(prints.where("n > 0").groupBy("key").agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tie")).alias("first"), F.any_value("n").alias("n"),
        F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))
    buckets = nodes.select("id", "n", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    members = staged(buckets.join(shared, "band"))
    close = (100 * F.least("na", "nb") >= least * F.greatest("na", "nb"))
    numbered = nodes.select("id", "n", "sig")

    # full sets of the nodes in shared buckets; their texts are found by a Bloom filter and an exact join
    wanted = staged(members.select("id").distinct().join(nodes.select("id", "key", F.col("first.doc_id").alias("doc_id")), "id"))
    blocks = bloom.geometry(wanted.count())
    filt = bloom.build(wanted, F.xxhash64("doc_id"), blocks)
    found = bloom.probe(texts, F.xxhash64("doc_id"), filt, blocks).where("maybe").drop("maybe")
    ids = wanted.select(F.col("doc_id").alias("d")).distinct()
    found = found.join(ids, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("text")
    made = found.mapInArrow(_full_sets(k), "key binary, elements array<long>").dropDuplicates(["key"])
    sets = staged(made.join(wanted.select("key", "id"), "key").select("id", "elements"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b) of ids, a < b."""
        a = numbered.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        b = numbered.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        likely = pairs.join(a, "a").join(b, "b").where(close).select("a", "b", "sa", "sb").mapInArrow(_agree(AGREE), "a long, b long")
        both = (likely.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b"))
        both = both.withColumn("inter", F.size(F.array_intersect("ea", "eb")))
        return both.where(100 * F.col("inter") >= least * (F.size("ea") + F.size("eb") - F.col("inter"))).select("a", "b")

    def paired(df: DataFrame, *others: str) -> DataFrame:
        """Pairs of id with other columns, smaller first, each once."""
        pairs = df.select("id", F.explode(F.array(*others)).alias("o")).where("id <> o")
        return pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()

    links = staged(confirmed(paired(members, "lo", "hi")))
    roots = components(links)
    # members of buckets that still hold several components meet in families, named by their smallest root
    now = members.select("band", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = now.groupBy("band").agg(F.min("root").alias("family"), F.max("root").alias("r1")).where("family < r1").select("band", "family")
    now = now.join(mixed, "band").select("family", "id", "root").distinct()
    asks = F.col("root") != F.col("family")
    parts = now.groupBy("family").agg(F.ceil(F.count("*") / FAMILY).alias("rows"), F.ceil(F.count_if(asks) / FAMILY).alias("probes"))
    now = staged(now.join(parts, "family").withColumn("h", F.xxhash64("id")))
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    index = now.select("family", "id", "root", F.lit(False).alias("asks"), F.pmod("h", "rows").alias("r"), F.explode(to("probes")).alias("p"))
    probes = now.where(asks).select("family", "id", "root", F.lit(True).alias("asks"), F.explode(to("rows")).alias("r"), F.pmod("h", "probes").alias("p"))
    met = index.unionByName(probes).join(sets, "id")
    shards = max(1, -(-now.count() // FAMILY))
    more = by_shard(met, F.xxhash64("family", "r", "p"), shards).applyInArrow(
        lambda t: _family_links(least)(t), "a long, b long")
    more = staged(more.distinct())
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    named = nodes.select("id", "key", "first").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = staged(named.groupBy("root").agg(F.min("first").alias("first")))  # read again, so that both sides are exchanged
    named = named.drop("first").join(firsts, "root")
    # joined on an expression, so both sides are exchanged and AQE can split a set on many rows
    out = prints.select("doc_id", "tie", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.hex("key")).alias("k"))
    met = out.where("k is not null").join(named.select(F.hex("key").alias("k"), "first"), "k").drop("k")
    alone = out.where("k is null").drop("k").withColumn("first", F.lit(None).cast(met.schema["first"].dataType))
    return met.unionByName(alone)


def groups(docs: DataFrame, k: int = 5, least: int = LEAST, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    out = _rows(docs, k, least, slots, rows)
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, least: int = LEAST) -> DataFrame:
    """The documents that stay, with their own columns: the first of each component, by
    doc_id (null last), then by a hash of the text; rows equal in both stay or go together.

    Only rows that a Bloom filter of the dropped ones lets through are shuffled."""
    out = _rows(docs, k, least, SLOTS, ROWS).where("n_shingles > 0")
    gone = staged(out.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))).select("doc_id", "tie").distinct())
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", F.xxhash64(text_of()).alias("tie"))
    key = F.xxhash64("doc_id", "tie")
    blocks = bloom.geometry(gone.count())
    seen = bloom.probe(work, key, bloom.build(gone, key, blocks), blocks)
    gone = gone.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"))
    left = seen.where("maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left_anti")
    return seen.where(~F.col("maybe")).select("row.*").unionByName(left.select("row.*"))
