"""Near-duplicate vectors: product quantisation in inverted lists, exact cosine of what remains.

1. Vectors are scaled to length 1.  Equal vectors of a label become one node that carries their
   number.
2. A coarse quantiser (k-means) and codebooks of the residuals' subspaces (8 dimensions, up to
   256 codes each) are fitted to a sample of at most `SAMPLE` nodes.  Every node is indexed: it
   goes to its nearest cell's list, with the codes of its residual and the residual's exact
   quantisation error.
3. A node asks the lists of all cells that a neighbour at the least cosine may lie in: those
   whose border, the plane halfway between the two centres, is within `_margin` of the node.
   The full distance would miss nothing; half of it (but at least three standard deviations of
   a step in a random direction) asks far fewer lists, and a pair is missed only if each end lies
   beyond it for the other's list.
4. Lists and their askers meet in blocks of at most `BLOCK` each, so a list may be of any length.
   Table look-ups give the asymmetric distances to the codes.  By the triangle inequality a
   distance less the stored error is a lower bound, so no pair is refused wrongly; the rest is
   decided by the cosine in double precision.  A task returns for each node how many links it
   found and the smallest node it reaches, never the pairs.
5. Links are joined into components (large-star / small-star rounds).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label, link with nothing and are kept; vectors of different lengths are not
compared; rows that repeat a vec_id or a vector are vectors of their own; a null vec_id takes part
and never names a component that has a number; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import by_shard, staged
from tollgate.llm.minhash_dedup import components

LEAST = 0.93
#: The quantisers' sample: rows, and bytes on the driver.
SAMPLE, SAMPLE_BYTES = 32_768, 64 << 20
WIDTH, CODES, MAX_CELLS, ROUNDS = 8, 256, 4096, 10
BLOCK, ASKERS = 4096, 512
#: Room for rounding in the single-precision tables.
SLACK = 1e-3


def _distance(least: float) -> float:
    """Of two unit vectors with that cosine."""
    return float(np.sqrt(2 - 2 * least))


def _margin(least: float, dims: int) -> float:
    return _distance(least) * min(1.0, max(0.5, 3 / np.sqrt(max(dims, 1))))


# --- vectors -------------------------------------------------------------------------------------

def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (null as NaN), begins and ends of a list column; a null list is empty."""
    at = column.offsets.to_numpy().astype(np.int64)
    none = column.is_null().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values, at[:-1], np.where(none, at[:-1], at[1:])


def _units(batches):
    """Each row's vector at length 1 as bytes, and a digest of its components; both null where it
    can't be linked."""
    for batch in batches:
        values, begin, end = _lists(batch.column("v"))
        labelled = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        units, keys = [None] * batch.num_rows, [None] * batch.num_rows
        for d in np.unique(end - begin):
            rows = np.flatnonzero((end - begin == d) & labelled) if d else []
            if not len(rows):
                continue
            x = values[begin[rows][:, None] + np.arange(d)] + 0.0  # -0.0 as 0.0
            top = np.abs(x).max(axis=1)
            fit = np.isfinite(x).all(axis=1) & (top > 0)
            rows, x, top = rows[fit], x[fit], top[fit]
            u = x / top[:, None]  # first, so that squares neither overflow nor vanish
            u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
            for r, own, unit in zip(rows.tolist(), x, u):
                keys[r], units[r] = hashlib.sha256(own.tobytes()).digest(), unit.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array((end - begin).astype(np.int32)),
             pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "key", "unit"])


def _matrix(column, dims: int) -> np.ndarray:
    """Unit vectors from bytes, shorter ones filled with zeros."""
    cells = column.to_pylist()
    out = np.zeros((len(cells), dims))
    for i, c in enumerate(cells):
        v = np.frombuffer(c)
        out[i, :len(v)] = v
    return out


# --- quantisers ----------------------------------------------------------------------------------

def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    return np.concatenate([np.argmin(half - x[i:i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres after `ROUNDS` rounds from k rows of x drawn at random; an empty cell's stays."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, c, minlength=len(centres)) for c in x.T], axis=1)
        centres[n > 0] = (total[n > 0] / n[n > 0][:, None]).astype(x.dtype)
    return centres


class Quantiser:
    """Cell centres, and a codebook for each `WIDTH` dimensions of the residuals."""

    def __init__(self, sample: np.ndarray, cells: int, dims: int):
        self.dims = dims
        self.wide = -(-max(dims, 1) // WIDTH) * WIDTH  # filled up with zeros
        x = np.zeros((max(1, len(sample)), self.wide), np.float32)
        x[:len(sample), :dims] = sample
        self.centres = kmeans(x, max(1, min(cells, len(x))), 1)
        rest = x - self.centres[_nearest(x, self.centres)]
        codes = max(1, min(CODES, len(x) // 4))
        self.books = np.stack([kmeans(np.ascontiguousarray(rest[:, m:m + WIDTH]), codes, m) for m in range(0, self.wide, WIDTH)])

    def fill(self, unit: np.ndarray) -> np.ndarray:
        x = np.zeros((len(unit), self.wide), np.float32)
        x[:, :unit.shape[1]] = unit
        return x

    def index(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Cell, codes and quantisation error of each row, and the cells it asks."""
        norm = np.einsum("ij,ij->i", self.centres, self.centres)
        far = norm - 2 * (x @ self.centres.T)  # squared distance less |x|^2
        cell = np.argmin(far, axis=1)
        apart = np.sqrt(np.maximum(norm + norm[cell][:, None] - 2 * (self.centres[cell] @ self.centres.T), 1e-12))
        asked = far - far[np.arange(len(x)), cell][:, None] <= 2 * margin * apart + 1e-6
        rest = x - self.centres[cell]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, m * WIDTH:(m + 1) * WIDTH]
            codes[:, m] = _nearest(part, book)
            error += ((part - book[codes[:, m]]).astype(np.float64) ** 2).sum(axis=1)
        return cell, codes, np.sqrt(error), [np.flatnonzero(a) for a in asked]

    def tables(self, asks: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of each asker's residual from every code: [subspace, code, asker]."""
        rest = asks - self.centres[cell]
        out = np.empty((len(self.books), self.books.shape[1], len(asks)), np.float32)
        for m, book in enumerate(self.books):
            part = rest[:, m * WIDTH:(m + 1) * WIDTH]
            out[m] = (book ** 2).sum(axis=1)[:, None] - 2 * (book @ part.T) + (part ** 2).sum(axis=1)
        return out


def _sample(nodes: DataFrame, n: int, dims: int) -> np.ndarray:
    """Unit vectors of at most `SAMPLE` nodes (fewer if they are very long), drawn by a hash."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(dims, 1))))
    share = int(min(1.0, most / max(n, 1)) * (1 << 30))
    rows = nodes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share).select("key", "unit").limit(2 * most).toArrow()
    order = np.argsort(np.array(rows.column("key").to_pylist(), object), kind="stable")
    return _matrix(rows.column("unit").take(pa.array(order, pa.int64())), dims).astype(np.float32)


def _index(quantiser: Quantiser, margin: float):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cell, codes, error, asked = quantiser.index(quantiser.fill(_matrix(part.column("unit"), quantiser.dims)), margin)
                at = np.cumsum([0, *map(len, asked)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("id", "label", "dim", "w", "unit")], pa.array(cell.astype(np.int32)),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(asked).astype(np.int32)))],
                    names=["id", "label", "dim", "w", "unit", "cell", "codes", "error", "asked"])
    return run


# --- search --------------------------------------------------------------------------------------

def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; a set is named by its smallest member."""
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _linked(x: np.ndarray, q: np.ndarray, near: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs left by the codes have the cosine (rows of x by rows of q)."""
    if 8 * np.count_nonzero(near) > near.size:
        return near & (x @ q.T >= least)
    a, b = np.nonzero(near)
    step = max(1, (1 << 21) // max(x.shape[1], 1))
    for i in range(0, len(a), step):
        s = slice(i, i + step)
        near[a[s], b[s]] = np.einsum("ij,ij->i", x[a[s]], q[b[s]]) >= least
    return near


def _search(quantiser: Quantiser, least: float):
    """Of each block (label, dim, list, r, p): links found by node, and the smallest node reached."""
    def block(cell: int, rows: pa.Table, asks: pa.Table):
        xid, xw = (rows.column(c).to_numpy() for c in ("id", "w"))
        qid, qw, qcell = (asks.column(c).to_numpy() for c in ("id", "w", "cell"))
        x, q = (_matrix(t.column("unit"), quantiser.dims) for t in (rows, asks))
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(xid), -1)
        reach = (_distance(least) + rows.column("error").to_numpy() + SLACK).astype(np.float32) ** 2
        back = rows.column("asked").to_pylist()
        owner = np.repeat(np.arange(len(back)), [len(b) for b in back])
        back = np.concatenate([np.array(b, np.int32) for b in back])
        ids = np.unique(np.concatenate([xid, qid]))
        xat, qat = np.searchsorted(ids, xid), np.searchsorted(ids, qid)
        parent, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for i in range(0, len(qid), ASKERS):
            s = slice(i, i + ASKERS)
            tables = quantiser.tables(quantiser.fill(q[s]), cell)
            far = np.zeros((len(xid), tables.shape[2]), np.float32)
            for m in range(len(tables)):
                far += tables[m][codes[:, m]]
            # of a pair that both ends ask for, only one finding counts: that in the smaller list, or of the smaller row
            cells, which = np.unique(qcell[s], return_inverse=True)
            counts = np.zeros((len(xid), len(cells)), bool)
            for k, c in enumerate(cells):
                if c > cell:
                    counts[:, k] = True
                elif c < cell:
                    counts[:, k] = True
                    counts[owner[back == c], k] = False
            allowed = counts[:, which]
            own = np.flatnonzero(qcell[s] == cell)
            allowed[:, own] = xid[:, None] < qid[s][own]
            links = _linked(x, q[s], (far <= reach[:, None]) & allowed, least)
            a, b = np.nonzero(links)
            n += np.bincount(xat, links @ qw[s], minlength=len(ids)).astype(np.int64)
            n += np.bincount(qat[s], xw @ links, minlength=len(ids)).astype(np.int64)
            _join(parent, xat[a], qat[s][b])
        some = n > 0
        return ids[some], n[some], ids[parent[some]]

    def run(table: pa.Table) -> pa.Table:
        names = ["label", "dim", "list", "r", "p"]
        table = table.sort_by([(c, "ascending") for c in [*names, "asks", "id"]])
        key = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in names]
        edge = np.ones(table.num_rows + 1, bool)
        edge[1:-1] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        edge = np.flatnonzero(edge)
        asks, cells = table.column("asks").to_numpy(zero_copy_only=False), table.column("list").to_numpy()
        found = [block(int(cells[lo]), table.slice(lo, mid - lo), table.slice(mid, hi - mid)) for lo, hi in zip(edge, edge[1:])
                 if lo < (mid := lo + int((~asks[lo:hi]).sum())) < hi]
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("id", "n", "root"), cols)))
    return run


def _nodes(rows: DataFrame) -> DataFrame:
    nodes = rows.where("unit is not null").groupBy("label", "dim", "key").agg(
        F.count("*").alias("w"), F.min("vec_id").alias("first"), F.any_value("unit").alias("unit"))
    return staged(nodes.withColumn("id", F.monotonically_increasing_id()))


def _links(nodes: DataFrame, least: float) -> DataFrame:
    """(id, n, root) by node and block: links found there, and the smallest node they reach."""
    size = nodes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels"), F.max("dim").alias("dims")).first()
    n, dims = size.n, size.dims or 0
    sample = _sample(nodes, n, dims)
    cells = max(1, min(MAX_CELLS, len(sample) // 8, round(np.sqrt(n / max(size.labels, 1)) / 2)))
    quantiser = Quantiser(sample, cells, dims)
    index = staged(nodes.select("id", "label", "dim", "w", "unit").mapInArrow(
        _index(quantiser, _margin(least, dims)),
        "id long, label string, dim int, w long, unit binary, cell int, codes binary, error double, asked array<int>"))
    at = ["label", "dim", "list"]
    rows = index.withColumn("list", F.col("cell"))
    asks = index.withColumn("list", F.explode("asked")).drop("codes", "error", "asked")
    sizes = rows.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("nr")).join(
        asks.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("np"), F.count("*").alias("n")), at)
    sizes = staged(sizes)
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    h = F.xxhash64("id")
    rows = rows.join(sizes, at).withColumn("r", F.pmod(h, "nr")).withColumn("p", to("np"))
    asks = asks.join(sizes, at).withColumn("p", F.pmod(h, "np")).withColumn("r", to("nr"))
    both = rows.withColumn("asks", F.lit(False)).drop("nr", "np", "n").unionByName(
        asks.withColumns({"asks": F.lit(True), "codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double"),
                          "asked": F.lit(None).cast("array<int>")}).drop("nr", "np", "n"))
    total = sizes.agg(F.sum(F.col("n") * (F.col("nr") + 1))).first()[0] or 0
    search = _search(quantiser, least)
    return staged(by_shard(both, F.xxhash64(*at, "r", "p"), max(1, -(-total // BLOCK))).applyInArrow(
        lambda t: search(t), "id long, n long, root long"))


def groups(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (`vec_id`, `embedding` and `label`
    of the input are read)."""
    rows = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                                 F.col("embedding").cast("array<double>").alias("v"))
                  .mapInArrow(_units, "vec_id long, label string, dim int, key binary, unit binary"))
    nodes = _nodes(rows)
    found = _links(nodes, least)
    roots = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    named = (nodes.drop("unit").join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(roots, "id", "left")
             .select(F.coalesce("root", "id").alias("root"), F.concat_ws(":", "label", "dim", F.hex("key")).alias("k"), "first",
                     (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    named = staged(named)
    firsts = staged(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = named.select("root", "k", "n_links").join(firsts, "root").drop("root")
    # joined on an expression, so both sides are exchanged and AQE can split a vector on many rows
    linkable = rows.where("unit is not null").select("vec_id", F.concat_ws(":", "label", "dim", F.hex("key")).alias("k"))
    met = linkable.join(named, "k").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
