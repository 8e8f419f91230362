"""Suffix-array dedup: bytes covered by a `LENGTH`-byte string that also starts earlier.

Any string of 100 bytes holds an anchor: the 64-byte window with the smallest hash in it,
which depends on its bytes alone.  A piece is an anchor with up to 36 bytes on either side;
it holds every string of 100 bytes around the anchor, so equal strings always meet among the
pieces of one anchor.

1. Anchors of all texts are counted; those that occur once are out.
2. Texts are read again; pieces around repeated anchors go to the anchor's shard as hashes.
   Of equal pieces only the first in the corpus stays, the others are covered whole; equal
   pieces in one batch meet before the shuffle.  An anchor left with one piece is done.
3. Pieces of anchors with several different surroundings form the collections.  Each shard
   builds its collection's Burrows-Wheeler transform, common prefixes and suffix order
   column-wise: every round inserts one symbol per piece.  An anchor counts as one symbol,
   so suffixes with a common prefix of 37 symbols and the same anchor are equal strings of
   100 bytes; all but the earliest are covered.
   An anchor that occurs more than `HOT` times is not sorted in one task: its equal pieces are
   found by grouped minima.  If more than `HOT` different pieces are left, each of their
   strings is a key of its own, the anchor with a hash of the bytes beside it, and all but
   the earliest of a key are covered; fewer go to the anchor's shard.
4. Each document's covered spans are merged and its other bytes kept.

The arrays of a collection are rewritten once per round, in order; over `SPILL` bytes they
are files in the task's own folder, removed as they are replaced.

Defined results: null and empty texts have no bytes; order is by doc_id, null first, then by
a hash of the text for rows that share a doc_id, then by start; rows equal in both are one
document and get equal results; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bloom, bytesnp
from tollgate.llm.common import by_shard, small, staged, text_of

LENGTH, ANCHOR = 100, 64
PIECES = 8192  # pieces of a shard, about
HOT = 8192  # occurrences, and different pieces, of an anchor that one task takes
SPILL = 64 << 20

_DOC = "doc long, tie long"


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) of every `width` neighbours."""
    n, span, m = len(a) - width + 1, 1, a
    while span * 2 <= width:
        m = pick(m[:-span], m[span:])
        span *= 2
    return pick(m[:n], m[width - span:width - span + n])


class Slice:
    """Anchors and piece hashes of neighbouring texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        self.length, self.anchor = length, anchor
        self.part, self.at = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        n = len(self.part)
        self.powers, self.inverse = bytesnp.powers(n + 1)
        self.sums = self._sums(bytesnp._tables()[0])
        self.places = self.owner = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        if n < length:
            return
        h = bytesnp.mix((self.sums[anchor:] - self.sums[:-anchor]) * self.inverse[:n - anchor + 1])
        low = _slide(h, length - anchor + 1, np.minimum)  # the smallest anchor of each string
        inside = np.zeros(len(low) + 1, np.int64)
        starts, ends = self.at[:-1], np.maximum(self.at[1:] - length + 1, self.at[:-1])
        some = ends > starts
        np.add.at(inside, starts[some], 1)
        np.add.at(inside, ends[some], -1)
        low[np.cumsum(inside[:-1]) == 0] = 0  # strings over the end of a text choose nothing
        edge = np.zeros(length - anchor, np.uint64)
        chosen = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), length - anchor + 1, np.maximum) == h)
        self.places, self.hashes = chosen, h[chosen]
        self.owner = np.searchsorted(self.at, chosen, "right") - 1

    def _sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.part) + 1, np.uint64)
        np.cumsum(values[self.part] * self.powers[:len(self.part)], out=out[1:])
        return out

    def keep(self, mask: np.ndarray) -> None:
        self.places, self.hashes, self.owner = self.places[mask], self.hashes[mask], self.owner[mask]

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each anchor's piece in the slice, and a hash of its bytes and the anchor's place."""
        start = np.maximum(self.places - (self.length - self.anchor), self.at[self.owner])
        end = np.minimum(self.places + self.length, self.at[self.owner + 1])
        h = bytesnp.mix((self.sums[end] - self.sums[start]) * self.inverse[start])
        h = bytesnp.mix(h ^ (self.places - start).astype(np.uint64) * np.uint64(bytesnp._BASE) ^ (end - start).astype(np.uint64) << np.uint64(32))
        return start, end, h


def _each(batch: pa.RecordBatch, length: int, anchor: int):
    data, offsets = bytesnp.flat(batch.column("text"))
    for i, j in bytesnp.slices(offsets):
        yield i, j, Slice(data, offsets[i:j + 1], length, anchor)


def _anchors(length: int, anchor: int):
    def run(batches):
        for batch in batches:
            for _, _, s in _each(batch, length, anchor):
                yield pa.RecordBatch.from_arrays([pa.array(s.hashes.view(np.int64))], names=["h"])
    return run


def _might(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """`bloom.probe` over an array: `bits` is blocks x 4096 bytes."""
    block = (h & np.uint64(len(bits) - 1)).astype(np.int64)
    out = np.ones(len(h), bool)
    for shift in (34, 49):
        p = (h >> np.uint64(shift) & np.uint64(bloom.BLOCK_BITS - 1)).astype(np.int64)
        out &= bits[block, p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1
    return out


def _collected(keys: DataFrame, column: str, n: int):
    """A Bloom filter as an array of every executor: at most 32 MB."""
    blocks = min(bloom.geometry(n), 1 << 13)
    bits = np.zeros((blocks, bloom.BLOCK_BITS // 8), np.uint8)
    for b, raw in bloom.build(keys, F.col(column), blocks).collect():
        bits[b] = np.frombuffer(raw, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _place_hash(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    h = bytesnp.mix(doc.astype(np.int64).view(np.uint64) ^ np.uint64(bytesnp._BASE))
    h = bytesnp.mix(h ^ tie.astype(np.int64).view(np.uint64))
    return bytesnp.mix(h + start.astype(np.uint64) * np.uint64(bytesnp._BASE))


def _first_of_equals(keys: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then places, each place of a key once (rows that repeat a document);
    and which rows in that order are the first of their key."""
    order = np.lexsort([*places[::-1], *keys[::-1]])
    if not len(order):
        return order, np.ones(0, bool)

    def changes(columns):
        return np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)])

    first, new = changes(keys), changes(keys + places)
    return order[new], first[new]


_ROW = ["h", "p", "doc", "tie", "start", "size"]


def _hashed_pieces(bits, length: int, anchor: int):
    """Rows (h, p, doc, tie, start, size) of pieces around repeated anchors; p is null for
    pieces that equal an earlier one of the batch: they are covered."""
    def run(batches):
        for batch in batches:
            doc, tie = (batch.column(c).to_numpy() for c in ("doc", "tie"))
            got = [[] for _ in _ROW]
            for i, _, s in _each(batch, length, anchor):
                s.keep(_might(s.hashes, bits.value))
                start, end, h = s.pieces()
                own = s.owner + i
                for c, v in zip(got, (s.hashes, h, doc[own], tie[own], start - s.at[s.owner], end - start)):
                    c.append(v)
            h, p, d, t, start, size = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in got)
            long = size >= length
            h, p, d, t, start, size = (c[long] for c in (h, p, d, t, start, size))
            order, first = _first_of_equals([h, p], [d, t, start])
            h, p, d, t, start, size = (c[order] for c in (h, p, d, t, start, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(p.view(np.int64), mask=~first), pa.array(d), pa.array(t),
                 pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=_ROW)
    return run


def _sort_out():
    """A shard's pieces by hash: covered ones (equal to an earlier one), and the first ones of
    anchors with several different pieces (`needed`)."""
    def run(table: pa.Table) -> pa.Table:
        h, p, d, t, start, size = (table.column(c).to_numpy() for c in _ROW)
        order, first = _first_of_equals([h, p], [d, t, start])
        h, d, t, start, size = (c[order] for c in (h, d, t, start, size))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        needed = first & (np.bincount(group, first, minlength=1)[group] > 1) if len(h) else first
        out = needed | ~first
        return pa.table({"needed": needed[out], "doc": d[out], "tie": t[out], "start": start[out], "size": size[out],
                         "place": _place_hash(d, t, start)[out].view(np.int64)})
    return run


def _whole_pieces(bits, wanted, length: int, anchor: int):
    """The bytes around the anchors of the pieces whose places are wanted."""
    def run(batches):
        for batch in batches:
            doc, tie = (batch.column(c).to_numpy() for c in ("doc", "tie"))
            for i, _, s in _each(batch, length, anchor):
                s.keep(_might(s.hashes, bits.value))
                start, end, _ = s.pieces()
                own, at = s.owner + i, start - s.at[s.owner]
                ok = (end - start >= length) & _might(_place_hash(doc[own], tie[own], at), wanted.value)
                start, end, own, at = start[ok], end[ok], own[ok], at[ok]
                back = s.places[ok] - start  # bytes before the anchor
                sizes = end - start - anchor
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
                take = np.repeat(start, sizes) + within + anchor * (within >= np.repeat(back, sizes))
                sides = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(s.part[take]))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.hashes[ok].view(np.int64)), pa.array(doc[own]), pa.array(tie[own]), pa.array(at.astype(np.int32)),
                     pa.array(back.astype(np.int32)), sides], names=["h", "doc", "tie", "start", "back", "sides"])
    return run


def _places():
    """The place hashes of pieces (doc, tie, start)."""
    def run(batches):
        for batch in batches:
            doc, tie, start = (batch.column(c).to_numpy() for c in ("doc", "tie", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(_place_hash(doc, tie, start).view(np.int64))], names=["place"])
    return run


def _strings(length: int, anchor: int):
    """All strings of `length` bytes around the pieces' anchors: anchor, hash of the bytes
    beside it and of their sides, place."""
    width = length - anchor

    def run(batches):
        for batch in batches:
            data, offsets = bytesnp.flat(batch.column("sides"))
            data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
            powers, inverse = bytesnp.powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(bytesnp._tables()[0][data] * powers[:len(data)], out=sums[1:])
            n = np.diff(offsets) - width + 1  # strings of each piece
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = offsets[row] + at
            k = bytesnp.mix((sums[first + width] - sums[first]) * inverse[first])
            left = batch.column("back").to_numpy()[row] - at  # bytes before the anchor
            k = bytesnp.mix(k ^ (left + 1).astype(np.uint64) * np.uint64(bytesnp._BASE))
            h, doc, tie, start = (batch.column(c).to_numpy()[row] for c in ("h", "doc", "tie", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k.view(np.int64)), pa.array(doc), pa.array(tie), pa.array((start + at).astype(np.int32))],
                                             names=["h", "k", "doc", "tie", "start"])
    return run


def _not_first(rows: DataFrame, keys: list[str], more: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by doc, tie and start, and the others: no key's rows meet in
    one task, as minima are combined map-side and the others joined out by key and place."""
    place = ["doc", "tie", "start"]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*place, *more)).alias("first")).select(*keys, "first.*")
    return first, rows.join(first.select(*keys, *place), [*keys, *place], "left_anti")


def _array(n: int, kind) -> np.ndarray:
    """A new array; a large one lies in a file of the task's folder that has no name any more."""
    size = n * np.dtype(kind).itemsize
    if size <= SPILL:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(size)
        return np.memmap(f, kind, "r+", shape=(n,))


def collection(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of many strings, built from their last symbols on.

    `text`: the strings' symbols; `at`: their n + 1 offsets.  Returns (string, length, common
    prefix with the suffix before) of all suffixes in order, and of the n empty ones.

    `bwt` holds the symbol before each suffix.  A round inserts, for each string, the suffix
    that its symbol makes of the suffix inserted before: its place follows from the number of
    smaller and of equal earlier symbols, and its common prefixes, with the suffix before and
    with the one after, are one more than the smallest prefix between the two equal symbols.
    """
    n, sizes = len(at) - 1, np.diff(at)
    present = np.bincount(text, minlength=1) > 0
    stop = int(present.sum())  # sorts last: nothing is inserted after a string's first symbol
    kind = np.uint8 if stop < 1 << 8 else np.uint16 if stop < 1 << 16 else np.uint32
    text = (np.cumsum(present) - 1).astype(kind)[text]

    def symbol(ids: np.ndarray, done: int) -> np.ndarray:
        """Symbol before the suffix of length `done`."""
        left = sizes[ids] - done
        return np.where(left > 0, text[np.maximum(at[ids] + left - 1, 0)] if len(text) else 0, stop).astype(kind)

    live = np.arange(n)
    place = np.arange(n)
    rounds = int(sizes.max(initial=0))
    bwt, lcp = symbol(live, 0), np.zeros(n, np.uint8 if rounds < 255 else np.int32)
    for done in range(1, rounds + 1):
        going = sizes[live] >= done
        live, place = live[going], place[going]
        by = np.argsort(bwt, kind="stable")  # places of the symbols, in order
        rank = np.empty(len(bwt), np.int32)
        rank[by] = np.arange(len(bwt), dtype=np.int32)
        mine = rank[place].astype(np.int64)
        new = n + mine
        # common prefixes with the neighbours in the new order: equal symbols before and after
        before, after = by[np.maximum(mine - 1, 0)], by[np.minimum(mine + 1, len(by) - 1)]
        has_before = (mine > 0) & (bwt[before] == bwt[place])
        has_after = (mine + 1 < len(by)) & (bwt[after] == bwt[place])
        low = np.concatenate([before[has_before] + 1, place[has_after] + 1])
        high = np.concatenate([place[has_before], after[has_after]]) + 1
        order = np.argsort(low, kind="stable")
        ends = np.empty(2 * len(low), np.int64)
        ends[0::2], ends[1::2] = low[order], high[order]
        least = np.empty(len(low), lcp.dtype)
        if len(low):
            least[order] = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), ends)[::2]
        with_before, with_after = np.zeros(len(new), lcp.dtype), np.zeros(len(new), lcp.dtype)
        with_before[has_before] = least[:has_before.sum()] + 1
        with_after[has_after] = least[has_before.sum():] + 1
        # both arrays are written anew, in order
        total = len(bwt) + len(new)
        old = np.ones(total, bool)
        old[new] = False
        moved = []
        for a, v in ((bwt, symbol(live, done)), (lcp, with_before)):
            b = _array(total, a.dtype)
            b[old], b[new] = a, v
            moved.append(b)
        bwt, lcp = moved
        follows = new + 1 < total
        lcp[new[follows] + 1] = with_after[follows]
        place = new
    # each string's suffixes once more from the shortest on: their places in the final order
    by = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[by] = np.arange(len(bwt))
    string, length = np.empty(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    live = place = np.arange(n)
    string[:n] = live
    for done in range(1, rounds + 1):
        going = sizes[live] >= done
        live, place = live[going], n + rank[place[going]]
        string[place], length[place] = live, done
    return string, length, lcp


def repeated(text: np.ndarray, at: np.ndarray, group: np.ndarray, places: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the strings of `length` symbols that also start earlier in their
    group; `places` order the collection's strings, the first key first; offsets break ties."""
    string, size, lcp = collection(text, at)
    run = np.cumsum(lcp < length)  # suffixes of one run share `length` symbols
    string, size, run = (a[size >= length] for a in (string, size, run))
    offset = np.diff(at)[string] - size
    keys = [p[string] for p in places[:-1]] + [places[-1][string] + offset]
    order, first = _first_of_equals([run, group[string]], keys)  # one place may be in several pieces
    late = order[~first]
    return string[late], offset[late]


def _shard(length: int, anchor: int):
    def run(table: pa.Table) -> pa.Table:
        h, doc, tie, start, back = (table.column(c).to_numpy() for c in ("h", "doc", "tie", "start", "back"))
        order = np.lexsort([start, tie, doc])
        sides = table.column("sides").cast(pa.large_binary()).combine_chunks()
        sides = pa.concat_arrays(sides.chunks) if isinstance(sides, pa.ChunkedArray) else sides
        data, offsets = bytesnp.flat(sides.take(pa.array(order)))
        h, doc, tie, start, back = h[order], doc[order], tie[order], start[order].astype(np.int64), back[order]
        # the pieces' symbols: the bytes, and 256 for the anchor
        offsets = offsets - offsets[0]
        anchors = offsets[:-1] + np.arange(len(back)) + back
        text = np.empty(offsets[-1] + len(back), np.int64)
        other = np.ones(len(text), bool)
        other[anchors] = False
        text[other], text[anchors] = data[:offsets[-1]], 256
        string, offset = repeated(text, offsets + np.arange(len(offsets)), h, [doc, tie, start], length - anchor + 1)
        d, t, s = doc[string], tie[string], start[string] + offset
        order = np.lexsort([s, t, d])
        d, t, s = d[order], t[order], s[order]
        # neighbouring strings make one span
        new = np.ones(len(s), bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + length)
        lead = np.flatnonzero(new)
        end = s[np.append(lead[1:], len(s)) - 1] + length if len(s) else s
        return pa.table({"doc": d[lead], "tie": t[lead], "start": s[lead].astype(np.int32), "size": (end - s[lead]).astype(np.int32)})
    return run


def _keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc, tie, text; the tie only tells rows apart that share a doc_id."""
    twice = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    tie = F.xxhash64(text_of()) if twice else F.lit(0).cast("long")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"), tie.alias("tie"), text_of().alias("text")), twice


def spans(keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Covered spans (doc, tie, start, size), not merged; `keyed` has doc, tie and text."""
    span = ["doc", "tie", "start", "size"]
    texts = keyed.select("doc", "tie", "text")
    counted = texts.select("text").mapInArrow(_anchors(length, anchor), "h long")
    often = staged(counted.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    busy = often.where(F.col("n") > hot).select("h")
    n_often, n_busy = often.agg(F.count("*"), F.count_if(F.col("n") > hot)).first()
    bits = _collected(often.select("h"), "h", n_often)
    rows = texts.mapInArrow(_hashed_pieces(bits, length, anchor), "h long, p long, doc long, tie long, start int, size int")
    rows = staged(rows)
    out = rows.where("p is null").select(span)
    own = rows.where("p is not null")
    if n_busy:
        busy = small(busy, n_busy, 24)
        first, copies = _not_first(own.join(busy, "h", "left_semi").distinct(), ["h", "p"], ["size"])
        out = out.unionByName(copies.select(span))
        own = own.join(busy, "h", "left_anti")
        first = staged(first)
        per = staged(first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))  # at most `n_busy` rows
        n_mixed, n_crowd = per.agg(F.count("*"), F.count_if(F.col("n") > hot)).first()
        first = first.join(small(per.select("h"), n_mixed, 24), "h", "left_semi")
        crowd = small(per.where(F.col("n") > hot).select("h"), n_crowd, 24)
    shards = max(1, -(-rows.count() // (16 * PIECES)))
    met = by_shard(own, F.col("h"), shards).applyInArrow(
        lambda t: _sort_out()(t), "needed boolean, doc long, tie long, start int, size int, place long")
    met = staged(met)
    needed = met.where("needed").select("place")
    if n_busy and n_mixed:
        needed = staged(needed.unionByName(first.mapInArrow(_places(), "place long")))
    n = needed.count()
    wanted = _collected(needed, "place", n)
    pieces = texts.mapInArrow(_whole_pieces(bits, wanted, length, anchor), "h long, doc long, tie long, start int, back int, sides binary")
    if n_busy:
        pieces = staged(pieces)
        # of a frequent anchor only the first of equal pieces, whatever the filter lets through
        often = pieces.join(busy, "h", "left_semi").join(first.select("h", *span[:3]), ["h", *span[:3]], "left_semi")
        pieces = pieces.join(busy, "h", "left_anti")
        if n_mixed > n_crowd:
            pieces = pieces.unionByName(often.join(crowd, "h", "left_anti"))
        if n_crowd:
            strings = often.join(crowd, "h", "left_semi").mapInArrow(_strings(length, anchor), "h long, k long, doc long, tie long, start int")
            _, late = _not_first(strings.distinct(), ["h", "k"], [])
            out = out.unionByName(late.select("doc", "tie", "start", F.lit(length).alias("size")))
    shards = max(1, -(-n // PIECES))
    late = by_shard(pieces, F.col("h"), shards).applyInArrow(
        lambda t: _shard(length, anchor)(t), "doc long, tie long, start int, size int")
    return staged(late.unionByName(out).unionByName(met.where("not needed").select(span)))


def _runs(spans: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal covered runs of a batch's rows, in order."""
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
    packed = spans.flatten().to_numpy()
    base = np.repeat(np.arange(n, dtype=np.int64) << 33, sizes)  # rows follow each other without touching
    start = base + (packed >> 32)
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + (packed & 0xFFFFFFFF))[order]
    top = np.maximum.accumulate(end)
    lead = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]])) if len(start) else np.zeros(0, np.int64)
    row = start[lead] >> 33
    end = top[np.append(lead[1:], len(top)) - 1] if len(lead) else top
    return row, start[lead] - (row << 33), end - (row << 33)


def _cut():
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            data, offsets = bytesnp.flat(batch.column("text"))
            data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
            row, start, end = _runs(batch.column("spans"), n)
            n_bytes = np.diff(offsets)
            n_removed = np.bincount(row, end - start, minlength=n).astype(np.int64)
            n_spans = np.bincount(row, minlength=n)
            step = np.zeros(len(data) + 1, np.int8)
            np.add.at(step, offsets[row] + start, 1)
            np.add.at(step, offsets[row] + end, -1)
            left = np.ascontiguousarray(data[np.cumsum(step[:-1], dtype=np.int8) == 0])
            at = np.concatenate([[0], np.cumsum(n_bytes - n_removed)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(left)])
            removed = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), kept, removed],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])
    return run


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes), removed (spans)."""
    keyed, _ = _keys(docs)
    cover = spans(keyed, length, anchor, hot)
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("size").cast("long"))
    per = cover.groupBy("doc", "tie").agg(F.collect_list(packed).alias("spans"))  # of one document
    blocks = bloom.geometry(docs.count())
    key = F.xxhash64("doc", "tie")
    probed = bloom.probe(keyed, key, bloom.build(cover.select("doc", "tie").distinct(), key, blocks), blocks)
    # texts without spans are not shuffled
    hit = probed.where("maybe").join(per, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    free = probed.where(~F.col("maybe")).select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start long, end long>>"
    return free.mapInArrow(_cut(), out).unionByName(hit.mapInArrow(_cut(), out))


def report(found: DataFrame) -> DataFrame:
    """The counts, and the hash of the bytes kept."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
