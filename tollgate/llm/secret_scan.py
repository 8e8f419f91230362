"""Secret scans: key patterns, and guess-cost of the values that stand where credentials do.

A value's cost is the decimal logarithm of the guesses an attacker needs: dynamic programming
takes the cheapest segmentation into dictionary words (with case and look-alike variants),
dates, repeats, keyboard and alphabet walks, and brute-force characters at ten guesses each.
The dictionary is a list of common passwords, and the words of the table itself by the number
of their documents: at most `TABLE_WORDS` runs of 3 to 24 lower-cased letters that at least
`LEAST_DOCS` documents hold outside the values in credential contexts, so that a secret does
not become a word by being repeated; and the words of a public vocabulary by their rank.
A value after a credential keyword is reported as kind "guess" if its cost is at least
`LEAST_COST`: placeholders and plain words stay under it, keys and strong passwords don't.
The key patterns (kinds assign, access, hex) are reported whatever their cost.

Defined results: null and empty texts have no spans; positions are code points, ends are
exclusive; spans of one kind don't overlap, spans of different kinds may; repeated rows are
scanned each; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bytesnp
from tollgate.llm.common import text_of

KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 8.0
LEAST_LENGTH = 6
TABLE_WORDS, LEAST_DOCS = 50_000, 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Credential context: a keyword, an optional quote, a separator, an optional quote, the value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?)["']?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*["'`]?([^\s"'`,;<>()]+)""", re.I | re.A)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
_CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential")
_HEX_RUN = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))

#: Common passwords and placeholder words, most common first.
WORDS = """password 123456 qwerty letmein welcome admin login master dragon monkey football baseball shadow sunshine
princess iloveyou superman batman trustno secret abc123 hello freedom whatever computer internet access default
changeme example sample test testing user guest root system server database service token key pass word your my the
here value string insert placeholder none null true false undefined redacted removed hidden private public access
api app client code demo dev development enter foo bar baz host local localhost prod production project staging
temp name email account summer winter spring autumn monday friday january october december love life star king
queen magic ninja hunter ranger soccer hockey killer pepper ginger cookie orange banana purple silver golden
""".split()
_LETTERS = re.compile(r"[^\W\d_]{3,24}")
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(dict.fromkeys(WORDS))))}
_LONGEST = max(map(len, _RANK))
_ALIKE = str.maketrans("@4310$57!", "aaeiossti")
_YEARS = 120

#: Walks: neighbouring keys by row and column of a keyboard, and neighbouring letters.
_PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:\d{1,2}([-/._])\d{1,2}\1(?:\d{4}|\d\d)|\d{4}([-/._])\d{1,2}\2\d{1,2}|(?:19|20)\d{6}|\d{4}(?:19|20)\d\d|(?:19|20)\d\d)")


def _step(a: str, b: str):
    """The direction of one step of a walk, or None."""
    if a.isalpha() and b.isalpha() and a.isascii() and b.isascii() and abs(ord(a) - ord(b)) == 1:
        return "abc", ord(b) - ord(a)
    if a in _PLACE and b in _PLACE and a != b:
        (r, c), (s, d) = _PLACE[a], _PLACE[b]
        if abs(r - s) <= 1 and abs(c - d) <= 1:
            return "keys", r - s, c - d
    return None


def _word_cost(part: str, ranks: dict[str, int] = _RANK) -> float | None:
    low = part.lower()
    rank, variants = ranks.get(low), 0
    if rank is None:
        rank, variants = ranks.get(low.translate(_ALIKE)), sum(c in "@4310$57!" for c in low)
    if rank is None:
        return None
    upper = sum(c.isupper() for c in part)
    cased = 0.0 if not upper else math.log10(2) if upper == len(part) or part[0].isupper() and upper == 1 else math.log10(math.comb(len(part), upper) + 1)
    return math.log10(rank) + cased + variants * math.log10(2)


@lru_cache
def vocabulary() -> tuple[str, ...]:
    """Whole words of a public vocabulary, in the order of its merges, frequent ones first."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    return tuple(t[1:].decode().lower() for t in tokens if re.fullmatch(rb" [A-Za-z]{3,24}", t))


def table_words(docs: DataFrame, most: int = TABLE_WORDS, least: int = LEAST_DOCS) -> list[str]:
    """The table's words outside credential values, by falling number of their documents."""
    def found(batches):
        for batch in batches:
            n = Counter()
            data, offsets = bytesnp.flat(batch.column("text"))
            for a, b in zip(offsets, offsets[1:]):
                raw = data[a:b].tobytes()
                low = raw.lower()
                text = raw.decode()
                for pattern, hints in ((CONTEXT, _CONTEXT_WORDS), (ASSIGN, _ASSIGN_WORDS)):
                    if any(w in low for w in hints):
                        text = pattern.sub(" ", text)
                n.update(set(_LETTERS.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(found, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in top.collect()]  # at most `most` rows


def ranks_of(words: list[str]) -> dict[str, int]:
    """Each word's best rank in the three lists."""
    out = dict(_RANK)
    for names in (vocabulary(), words):
        for i, w in enumerate(names):
            out[w] = min(out.get(w, i + 1), i + 1)
    return out


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses of the cheapest segmentation."""
    n = len(value)
    low = value.lower()
    longest = _LONGEST if ranks is _RANK else 24
    best = [0.0] + [math.inf] * n
    # from each place: the last place of a walk, the bends before it, how long a period goes on
    steps = [_step(low[i], low[i + 1]) for i in range(n - 1)]
    walk, bends, same = list(range(n)), [0] * max(n, 1), {p: [0] * (n + 1) for p in range(1, 9)}
    for i in range(n - 2, -1, -1):
        walk[i] = walk[i + 1] if steps[i] else i
    for i in range(1, n - 1):
        bends[i] = bends[i - 1] + (steps[i] != steps[i - 1])
    for p, run in same.items():
        for i in range(n - p - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
    for i in range(n):
        here = best[i] + (math.log10(2) if i else 0.0)  # each further span adds a choice of the cut

        def offer(end: int, cost: float):
            if here + cost < best[end]:
                best[end] = here + cost

        best[i + 1] = min(best[i + 1], best[i] + 1.0)  # a brute-force span may end or go on anywhere
        for end in range(i + 2, min(n, i + longest) + 1):
            cost = _word_cost(value[i:end], ranks)
            if cost is not None:
                offer(end, cost)
        date = _DATE.match(value, i)
        if date:
            offer(date.end(), math.log10(_YEARS) + (math.log10(365) if date.end() - i > 4 else 0) + (math.log10(4) if date[1] or date[2] else 0))
        far = walk[i]
        for end in [*range(i + 2, min(far, i + 40)), far] if far - i >= 2 else ():
            offer(end + 1, math.log10(47) + (1 + bends[end - 1] - bends[i]) * math.log10(4.6) + math.log10(end - i + 1))
        for period in range(1, min(8, n - i) + 1):
            times = 1 + same[period][i] // period
            if times >= (3 if period == 1 else 2):
                word = _word_cost(value[i:i + period], ranks)
                offer(i + period * times, min(float(period), math.inf if word is None else word) + math.log10(times))
    return best[n]


def find(raw: bytes, least: float = LEAST_COST, ranks: dict[str, int] = _RANK) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, cost) of a text's spans; cost is NaN but for kind guess."""
    low = raw.lower()  # ASCII letters
    jobs = [any(w in low for w in _ASSIGN_WORDS), b"AKIA" in raw, b"x" * 32 in raw.translate(_HEX_RUN), any(w in low for w in _CONTEXT_WORDS)]
    if not any(jobs):
        return []
    text, out = raw.decode(), []
    if jobs[0]:
        out += [(m.start(), "assign", m.end(), math.nan) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if jobs[1]:
        out += [(m.start(), "access", m.end(), math.nan) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if jobs[2]:
        out += [(m.start(), "hex", m.end(), math.nan) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    if jobs[3]:
        for m in CONTEXT.finditer(text):
            if m.end(1) - m.start(1) >= LEAST_LENGTH and (cost := guess_cost(m[1], ranks)) >= least:
                out.append((m.start(1), "guess", m.end(1), cost))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _scan(least: float, ranks_from):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            ranks = ranks_from()
            data, offsets = bytesnp.flat(batch.column("text"))
            found = [[{"kind": k, "start": s, "end": e, "cost": c} for s, k, e, c in find(data[a:b].tobytes(), least, ranks)]
                     for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])
    return run


def scan(docs: DataFrame, least: float = LEAST_COST) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, cost) by start, then kind."""
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(table_words(docs)))
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _scan(least, lambda: ranks.value), "doc_id long, spans array<struct<kind string, start long, end long, cost double>>")


def report(spans: DataFrame) -> DataFrame:
    """Counts of the key patterns, the hash of their spans, and all spans as text."""
    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
