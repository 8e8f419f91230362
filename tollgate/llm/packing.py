"""Packing documents into fixed windows by lexical retrieval.

Texts are tokenized, each document ends with one end id, and is cut into full windows, which
are sequences of their own, and a tail.  Tails are dealt over shards of `SHARD` to twice
`SHARD` pieces by their content: a tree of balanced two-means splits, trained on a sample of
sketches of the tails' BM25 weights, leads each tail to its leaf.  A leaf that holds more
than four times `SHARD`, for instance of equal texts, is dealt on by hash.  A shard holds a BM25 inverted index of its tails (terms are token ids; the
document frequencies come from all pieces of the corpus).  The next unused tail is the
seed of a window; all its terms score the unused neighbours, which fill the window best
first.  The last one is cut where the window ends and what is left of it seeds
the next window, so only a shard's last sequence is shorter than a window.

Defined results: null and empty texts are the end id alone; repeated rows are packed each;
an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bytesnp
from tollgate.llm.common import small_batches, staged, text_of

WINDOW, END = 2048, 1
SHARD = 2048
NO_TOKEN = "\x00no token\x00"  # in a text: ordinary text
DIMS, SAMPLE, LEAVES = 128, 64, 4096  # of a sketch; sampled tails a leaf; leaves of the tree at most
K1, B = 1.2, 0.75
COMMON, DENSE = 32, 64 << 20  # a term in one piece of so many is a row of the index's matrix; bytes of that at most

_PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence long, offset long"


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # no text asks for a special token; without any, tiktoken's search for them stops at every character
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={NO_TOKEN: min(ranks.values())})


def _cut(path: str, window: int, end: int):
    """Documents to pieces; ids as little-endian 16-bit numbers where they fit."""
    def run(batches):
        enc = _encoder(path)
        kind = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        for batch in batches:
            for i, j in bytesnp.slices(bytesnp.flat(batch.column("text"))[1], 4 << 20):
                cols = ([], [], [], [], [])
                docs = batch.column("doc_id").slice(i, j - i).to_pylist()
                for doc, text in zip(docs, batch.column("text").slice(i, j - i).to_pylist()):
                    ids = np.append(enc.encode_to_numpy(text, disallowed_special=()), end).astype(kind)
                    for at in range(0, len(ids), window):
                        part = ids[at:at + window]
                        for c, v in zip(cols, (doc, at, len(part), len(ids), part.tobytes())):
                            c.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 names=["doc_id", "start", "length", "doc_tokens", "ids"])
    return run


def _ids(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and the offsets of its rows in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    data, offsets = bytesnp.flat(column)
    return data[offsets[0]:offsets[-1]].view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _terms(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, term, frequency), sorted by piece and term."""
    key = np.sort(np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at)) << 32 | ids.astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))


def _frequencies(kind, vocab: int):
    """Per batch: term, number of its pieces that hold it."""
    def run(batches):
        df, n = np.zeros(vocab, np.int64), 0
        for batch in batches:
            df += np.bincount(_terms(*_ids(batch.column("ids"), kind))[1], minlength=vocab)
            n += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["term", "n"])
    return run


def _weights(lengths: np.ndarray, piece: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of the pieces' terms."""
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[piece] / max(1.0, mean)))


def sketches(ids: np.ndarray, at: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """The pieces' BM25 weights, added with signs in `DIMS` buckets of terms, as unit vectors."""
    n, (piece, term, tf) = len(at) - 1, _terms(ids, at)
    h = bytesnp.mix(np.arange(len(idf), dtype=np.uint64) + np.uint64(1))
    slot, sign = (h % np.uint64(DIMS)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(40) & np.uint64(1)).astype(float)
    x = np.bincount(piece * DIMS + slot[term], _weights(np.diff(at), piece, term, tf, idf, mean) * sign[term], minlength=n * DIMS)
    x = x.reshape(n, DIMS).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits of the sketches in halves around two means each: directions and bounds by node
    (the children of k are 2k + 1 and 2k + 2), and the number of sketches by leaf."""
    directions, bounds = np.zeros(((1 << depth) - 1, x.shape[1]), np.float32), np.zeros((1 << depth) - 1, np.float32)
    members = [np.arange(len(x))]
    for k in range(len(bounds)):
        own = x[members[k]]
        if len(own):
            d = own[0] - own[-1]
            for _ in range(8):
                p = own @ d
                top = p > np.median(p)
                if not top.any():
                    break
                d = own[top].mean(axis=0) - own[~top].mean(axis=0)
            directions[k] = d
            bounds[k] = np.median(own @ d)
        top = own @ directions[k] > bounds[k]
        members += [members[k][~top], members[k][top]]
        members[k] = None
    return directions, bounds, np.array([len(m) for m in members[len(bounds):]])


def leaf_of(x: np.ndarray, directions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(len(bounds).bit_length()):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, directions[node]) > bounds[node])
    return node - len(bounds)


class _Index:
    """A shard's inverted index of its unused pieces.

    The terms that at least one piece in `COMMON` holds are rows of a matrix of weights, at most
    `DENSE` bytes of the most frequent ones; the others are postings by term."""

    def __init__(self, n: int, piece: np.ndarray, term: np.ndarray, weight: np.ndarray, vocab: int):
        df = np.bincount(term, minlength=vocab)
        often = np.argsort(-df, kind="stable")[:DENSE // (4 * max(1, n))]
        often = often[df[often] * COMMON >= max(1, n)]
        self.row = np.full(vocab, -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), n), np.float32)
        common = self.row[term] >= 0
        self.matrix[self.row[term[common]], piece[common]] = weight[common]
        rare = np.flatnonzero(~common)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.term, self.piece, self.weight = term[rare], piece[rare], weight[rare]
        self.pieces, self.vocab = np.arange(n), vocab
        self._posts()

    def _posts(self):
        self.posts = np.searchsorted(self.term, np.arange(self.vocab + 1))

    def shrink(self, unused: np.ndarray) -> None:
        """Drops the used pieces once they are a quarter of the indexed ones."""
        keep = unused[self.pieces]
        left = int(keep.sum())
        if 4 * left > 3 * len(keep):
            return
        self.matrix = np.compress(keep, self.matrix, axis=1)  # rows stay contiguous
        stay = keep[self.piece]
        self.term, self.weight = self.term[stay], self.weight[stay]
        self.piece = (np.cumsum(keep) - 1)[self.piece[stay]]
        self.pieces = self.pieces[keep]
        self._posts()

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of the indexed pieces for distinct terms."""
        row, out = self.row[terms], np.zeros(len(self.pieces), np.float32)
        common = row[row >= 0]
        for k in range(0, len(common), 16):  # a few rows at once, which stay in the cache
            out += self.matrix[common[k:k + 16]].sum(axis=0)
        spans = [slice(self.posts[t], self.posts[t + 1]) for t in terms[row < 0] if self.posts[t] < self.posts[t + 1]]
        if spans:
            out += np.bincount(np.concatenate([self.piece[s] for s in spans]),
                               np.concatenate([self.weight[s] for s in spans]), minlength=len(out)).astype(np.float32)
        return out


def fill(lengths: np.ndarray, piece: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, window: int, mean: float | None = None):
    """The windows of one shard: lists of (piece, start in it, length).

    `piece`, `term`, `tf`: the terms of each piece, sorted by piece; `mean`: of all tails' lengths."""
    n = len(lengths)
    weight = _weights(lengths, piece, term, tf, idf, (lengths.mean() if n else 1.0) if mean is None else mean)
    index = _Index(n, piece, term, weight, len(idf))
    rows = np.searchsorted(piece, np.arange(n + 1))
    unused, used_from = np.ones(n, bool), np.zeros(n, np.int64)
    at, cut, out = 0, None, []
    while True:
        if cut is None:
            while at < n and not unused[at]:
                at += 1
            if at == n:
                return out
            seed = at
        else:
            seed, cut = cut, None
        unused[seed] = False
        row, room = [], window

        def take(p, room):
            size = min(room, lengths[p] - used_from[p])
            row.append((p, used_from[p], size))
            used_from[p] += size
            unused[p] = False
            return size

        room -= take(seed, room)
        if room:
            index.shrink(unused)
            scores = index.scores(term[rows[seed]:rows[seed + 1]])
            scores[~unused[index.pieces]] = -1.0
            while room and scores.size:
                at_best = int(scores.argmax())
                if scores[at_best] < 0:
                    break
                scores[at_best] = -1.0
                best = int(index.pieces[at_best])
                room -= take(best, room)
                if used_from[best] < lengths[best]:
                    cut = best
        out.append(row)


def _sketched(kind, idf_of, mean: float):
    """The sketches of a sample, as bytes."""
    def run(batches):
        for batch in batches:
            x = sketches(*_ids(batch.column("ids"), kind), idf_of(), mean)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([v.tobytes() for v in x], pa.binary())], names=["rid", "x"])
    return run


def _dealt(kind, idf_of, mean: float, splits_of, first: np.ndarray):
    """Adds the shard; leaf k has the shards first[k] to first[k + 1] - 1."""
    def run(batches):
        for batch in batches:
            leaf = leaf_of(sketches(*_ids(batch.column("ids"), kind), idf_of(), mean), *splits_of())
            salt = bytesnp.mix(batch.column("rid").to_numpy().astype(np.uint64) + np.uint64(1))
            shard = first[leaf] + (salt % np.diff(first)[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])
    return run


def deal(tails: DataFrame, n: int, shard: int, kind, idf, mean: float) -> DataFrame:
    """The tails with their shards: a tree's leaves, large ones in several parts."""
    spark = tails.sparkSession
    depth = max(0, min(n // shard, LEAVES).bit_length() - 1)
    every = max(1, n // (SAMPLE << depth))
    sample = tails.where(F.pmod(F.xxhash64(F.lit(1), "rid"), F.lit(every)) == 0).select("rid", "ids")
    if depth:
        rows = sample.mapInArrow(_sketched(kind, lambda: idf.value, mean), "rid long, x binary").collect()  # at most about twice SAMPLE * LEAVES
        x = np.array([np.frombuffer(r["x"], np.float32) for r in sorted(rows)], np.float32).reshape(-1, DIMS)
    else:
        x = np.zeros((1, DIMS), np.float32)
    directions, bounds, sizes = tree(x, depth)
    first = np.append(0, np.cumsum(np.maximum(1, -(-sizes * n // (max(1, len(x)) * 4 * shard))))) if depth else np.array([0, 1])
    if first[-1] == 1:
        return tails.withColumn("shard", F.lit(0).cast("long"))
    splits = spark.sparkContext.broadcast((directions, bounds))
    return tails.mapInArrow(_dealt(kind, lambda: idf.value, mean, lambda: splits.value, first), _PIECE + ", rid long, shard long")


def _shards(kind, idf_of, window: int, mean: float):
    def run(table: pa.Table) -> pa.Table:
        idf = idf_of()
        table = table.sort_by("rid").combine_chunks()
        ids, at = _ids(table.column("ids"), kind)
        lengths = np.diff(at)
        doc, start, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        shard = table.column("shard")[0].as_py()
        cols = ([], [], [], [], [], [], [])
        for k, row in enumerate(fill(lengths, *_terms(ids, at), idf, window, mean)):
            offset = 0
            for p, frm, size in row:
                part = ids[at[p] + frm:at[p] + frm + size]
                values = (doc[p], start[p] + int(frm), int(size), total[p], part.tobytes(), (shard << 24 | k) * 2, offset)
                for c, v in zip(cols, values):
                    c.append(v)
                offset += int(size)
        types = (pa.int64(),) * 4 + (pa.binary(),) + (pa.int64(),) * 2
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                    names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence", "offset"])
    return run


def pack(docs: DataFrame, ranks: str | None = None, window: int = WINDOW, end: int = END, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (binary), sequence, offset.

    `ids` are little-endian numbers of 16 bits (32 for vocabularies over 65,536)."""
    small_batches(docs.sparkSession)
    path = ranks or default_ranks()
    vocab = _encoder(path).n_vocab
    kind = np.uint16 if vocab <= 1 << 16 else np.uint32
    texts = docs.select("doc_id", text_of().alias("text"))
    pieces = staged(texts.mapInArrow(_cut(path, window, end), _PIECE).withColumn("rid", F.monotonically_increasing_id()))
    # document frequencies of all pieces: at most one row per id of the vocabulary
    counts = pieces.select("ids").mapInArrow(_frequencies(kind, max(vocab, end + 1)), "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    df, total = np.zeros(max(vocab, end + 1)), 0
    for t, n in counts:
        if t < 0:
            total = n
        else:
            df[t] = n
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((total - df + 0.5) / (df + 0.5)))
    tails = pieces.where(F.col("length") < window)
    n, tokens = tails.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    mean = tokens / max(1, n)
    tails = deal(tails, n, shard, kind, idf, mean)
    packed = tails.groupBy("shard").applyInArrow(_shards(kind, lambda: idf.value, window, mean), _PACKED)
    whole = pieces.where(F.col("length") == window).select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.col("rid") * 2 + 1).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def _digest(kind):
    def run(batches):
        import zlib
        for batch in batches:
            ids, at = _ids(batch.column("ids"), kind)
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "length")] + [pa.array(crc, pa.int64())]
                + [batch.column(c) for c in ("doc_tokens", "sequence", "offset")],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def report(packed: DataFrame, wide: bool = False) -> DataFrame:
    """The pieces with the CRC-32 of their ids as little-endian 32-bit numbers instead of the ids."""
    return packed.mapInArrow(_digest(np.uint32 if wide else np.uint16),
                             "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
