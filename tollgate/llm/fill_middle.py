"""Fill-in-the-middle transformation over piece tables.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: the texts'
own UTF-8 bytes, as Arrow holds them, and the sentinels.  Cutting splits a descriptor at code
points, an arrangement permutes the descriptors and puts sentinel descriptors between them, and
the inverse permutation restores the text; SHA-256 values read the descriptors one after the
other.  Bytes are copied once, when the output column is filled.

Two numbers drawn from the document's id give the cuts, two more its form:

* ``psm``: `<P>` prefix `<S>` suffix `<M>` middle;
* ``spm``: `<S>` suffix `<P>` prefix `<M>` middle;
* ``plain``: the text as it is (empty texts, texts that hold a sentinel, and the share that is
  not transformed).

Defined results: a null text counts as empty; a null doc_id is drawn as an empty decimal;
repeated rows and rows with one doc_id each give a row, cut by their own lengths; an empty table
gives an empty result; a text of any length is counted in runs of `bytesnp.SLICE` bytes; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bytesnp
from tollgate.llm.common import text_of

#: Prefix, suffix and middle sentinel.
SENTINELS = ("<P>", "<S>", "<M>")
TEXT, MARKS = 0, 1  # the two buffers

#: Order of the parts in the output, and for each of prefix, middle and suffix its place there.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}


def _checked(sentinels) -> tuple[bytes, ...]:
    """The sentinels as bytes.  No end of one may begin another, so none can arise across a seam."""
    marks = tuple(s.encode() for s in sentinels)
    for a in marks:
        for b in marks:
            if any(a[i:] == b[:len(a) - i] for i in range(1, len(a))) or a != b and a in b or not a:
                raise ValueError(f"sentinels may not overlap: {a!r}, {b!r}")
    return marks


def _starts(part: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (part & 0xC0) != 0x80


def _points(text: np.ndarray) -> int:
    return sum(int(np.count_nonzero(_starts(text[i:i + bytesnp.SLICE]))) for i in range(0, len(text), bytesnp.SLICE))


def _byte_of(text: np.ndarray, points: list[int]) -> list[int]:
    """The byte at which each of the ascending code points begins (the end, for their number)."""
    found, seen = [], 0
    for i in range(0, len(text), bytesnp.SLICE):
        if len(found) == len(points):
            break
        at = np.flatnonzero(_starts(text[i:i + bytesnp.SLICE]))
        while len(found) < len(points) and points[len(found)] < seen + len(at):
            found.append(i + int(at[points[len(found)] - seen]))
        seen += len(at)
    return found + [len(text)] * (len(points) - len(found))


def _draws(seed: int, doc_id) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i:i + 8], 16) for i in (0, 8, 16, 24)]


def cut(lo: int, hi: int, at: list[int]) -> dict[str, tuple[int, int, int]]:
    """The text descriptor (lo, hi) split at two bytes."""
    a, b = lo + at[0], lo + at[1]
    return {"prefix": (TEXT, lo, a), "middle": (TEXT, a, b), "suffix": (TEXT, b, hi)}


def arrange(parts: dict, form: str, marks) -> list[tuple[int, int, int]]:
    """The output's descriptors: the form's permutation of the parts, each after its sentinel."""
    ends = np.cumsum([0, *map(len, marks)])
    mark = {k: (MARKS, int(ends[i]), int(ends[i + 1])) for i, k in enumerate(("prefix", "suffix", "middle"))}
    return [d for k in ORDER[form] for d in (mark[k], parts[k])]


def unarrange(output: bytes, lo: int, form: str, marks) -> list[tuple[int, int, int]]:
    """The text's descriptors over an output that begins at `lo` of its buffer: the parts found
    between the sentinels, put back by the inverse permutation."""
    mark, at = dict(zip(("prefix", "suffix", "middle"), marks)), 0
    begins = []
    for k in ORDER[form]:
        at = output.index(mark[k], at)
        begins.append((k, at, at + len(mark[k])))
        at += len(mark[k])
    ends = [b[1] for b in begins[1:]] + [len(output)]
    parts = {k: (TEXT, lo + begin, lo + end) for (k, _, begin), end in zip(begins, ends)}
    return [parts[k] for k in ("prefix", "middle", "suffix")]


def _read(pieces, buffers):
    return [buffers[b][lo:hi] for b, lo, hi in pieces]


def _sha256(views) -> str:
    h = hashlib.sha256()
    for v in views:
        h.update(v)
    return h.hexdigest()


def _strings(views: list[list]) -> pa.Array:
    """A string column whose values are the views of each row in turn."""
    at = np.zeros(len(views) + 1, np.int64)
    np.cumsum([sum(map(len, v)) for v in views], out=at[1:])
    data = b"".join(x for v in views for x in v)
    return pa.LargeStringArray.from_buffers(len(views), pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string())


def _transform(marks: tuple[bytes, ...], seed: int, rate: int, spm: int):
    def run(batches):
        joined = memoryview(b"".join(marks))
        for batch in batches:
            column = batch.column("text")
            data, offsets = bytesnp.flat(column)
            buffers = (memoryview(data), joined)
            marked = np.zeros(batch.num_rows, bool)
            for m in marks:
                marked |= pc.match_substring(column, m.decode()).to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_pylist()
            for i, j in bytesnp.slices(offsets):
                rows = []
                for r in range(i, j):
                    lo, hi = int(offsets[r]), int(offsets[r + 1])
                    n = _points(data[lo:hi])
                    h = _draws(seed, ids[r])
                    if not n or marked[r] or h[2] % 100 >= rate:
                        rows.append((n, "plain", None, None, [(TEXT, lo, hi)]))
                        continue
                    at = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    form = "spm" if h[3] % 100 < spm else "psm"
                    pieces = arrange(cut(lo, hi, _byte_of(data[lo:hi], at)), form, marks)
                    rows.append((n, form, at[0], at[1] - at[0], pieces))
                views = [_read(r[4], buffers) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                     _strings(views), pa.array([_sha256(v) for v in views], pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
    return run


def _restore(marks: tuple[bytes, ...], texts: bool):
    def run(batches):
        for batch in batches:
            data, offsets = bytesnp.flat(batch.column("output"))
            buffers, forms = (memoryview(data),), batch.column("form").to_pylist()
            for i, j in bytesnp.slices(offsets):
                views = []
                for r in range(i, j):
                    lo, hi = int(offsets[r]), int(offsets[r + 1])
                    pieces = [(TEXT, lo, hi)] if forms[r] == "plain" else unarrange(bytes(buffers[0][lo:hi]), lo, forms[r], marks)
                    views.append(_read(pieces, buffers))
                part = batch.slice(i, j - i)
                kept = [(c, part.column(c)) for c in part.schema.names if c != "output"]
                made = [("text", _strings(views))] if texts else []
                made.append(("restored_sha256", pa.array([_sha256(v) for v in views], pa.string())))
                yield pa.RecordBatch.from_arrays([c for _, c in kept + made], names=[c for c, _ in kept + made])
    return run


def transform(docs: DataFrame, sentinels=SENTINELS, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and output_sha256 of each document.

    `rate` per cent of the documents are transformed, `spm` per cent of those with the suffix first."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(_transform(_checked(sentinels), seed, rate, spm), schema)


def restore(made: DataFrame, sentinels=SENTINELS, texts: bool = True) -> DataFrame:
    """Rows of `transform` with the text rebuilt from output and form alone in place of the output,
    and its SHA-256; without `texts` only the latter."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema if f.name != "output")
    return made.mapInArrow(_restore(_checked(sentinels), texts), kept + (", text string" if texts else "") + ", restored_sha256 string")


def report(made: DataFrame) -> DataFrame:
    """Digests of the rows of `transform` and of what `restore` makes of them."""
    return restore(made, texts=False).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
