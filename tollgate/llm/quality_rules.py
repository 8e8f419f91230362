"""Quality rules: base rules and a hashed n-gram log-likelihood ratio; DataFrame functions only.

Two multinomials over `BUCKETS` hash buckets are counted over all documents: one of trusted
target documents, one of the raw corpus.  A document's n-grams are its words, its word pairs
and the last three characters of its words.  Its score is the mean over its n-grams of
log p_target - log p_raw.  It passes if the score is at least mean - `DEVIATIONS` standard
deviations of the trusted documents' scores, taken with each of their n-grams counted once
less in the target, so that they are not judged by themselves.  No draw is made: equal texts
get equal verdicts.

Defined results: null text has no words; documents under 50 words or with over half of
their words in repeated 3-word windows fail the base rules; without trusted documents every
ratio is zero and only the base rules decide; null and repeated label rows count once per
doc_id; repeated documents are judged and counted each; other columns pass through.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import SPACE, let, small, staged, text_of, words

BUCKETS = 10_000
DEVIATIONS = 4.0
SYMBOLS = "#*$%&|<>"


def _repeated_window_words(h: Column) -> Column:
    """Words in 3-word windows that occur at least twice, from the words' hashes.

    Windows are sorted with their positions, by the whole hash: equal ones are neighbours;
    their positions, sorted again, give the words covered.
    """
    long = lambda x: F.lit(x).cast("long")

    def found(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("at"))))
        same = lambda p, x, i: F.coalesce(x["h"] == F.get(p, i)["h"], F.lit(False))
        twice = let(placed, lambda p: F.filter(p, lambda x, i: same(p, x, i - 1) | same(p, x, i + 1)))
        at = F.sort_array(F.transform(twice, lambda x: x["at"]))
        return F.aggregate(
            at, F.struct(long(-3).alias("last"), long(0).alias("sum")),
            lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(long(3), x - s["last"])).alias("sum")))["sum"]

    windows = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
    windows = let(windows, lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(h, 3, F.size(h) - 2), lambda a, b: F.xxhash64(a, b)))
    # most documents end here: all windows differ
    return F.when(F.size(h) < 4, long(0)).otherwise(
        let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), long(0)).otherwise(found(v))))


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    """Adds the text, its words and the words' hashes."""
    docs = docs.withColumn("__t", text_of(text)).withColumn("__w", words(F.col("__t")))
    return docs.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))


def base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    docs = docs.withColumn("__l", lines)
    docs = docs.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": _repeated_window_words(F.col("__h"))})
    return docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("__l")


def _grams(buckets: int) -> Column:
    """Buckets of the words, the word pairs and the words' last three characters."""
    bucket = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    h = F.col("__h")
    pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)),
                       lambda a, b: bucket(F.xxhash64(a, b)))
    ends = F.transform("__w", lambda x: bucket(F.xxhash64(F.lit(3), F.right(x, F.lit(3)))))
    return F.concat(F.transform(h, bucket), pairs, ends)


def fit(docs: DataFrame, trusted: DataFrame, n_trusted: int, buckets: int) -> tuple[list[float], list[float]]:
    """The buckets' log ratios, counted over every document, and the same with one less in
    each bucket of the target; `trusted` has distinct doc_ids."""
    marked = docs.join(small(trusted.withColumn("__good", F.lit(1)), n_trusted, 24), "doc_id", "left")
    counts = (marked.select(F.explode(_grams(buckets)).alias("b"), "__good")
              .groupBy("b").agg(F.count("*").alias("raw"), F.count("__good").alias("good")).collect())
    raw, good = [1] * buckets, [1] * buckets  # one added to each bucket
    for b, r, g in counts:  # at most `buckets` rows
        raw[b] += r
        good[b] += g
    if sum(good) == buckets:
        return [0.0] * buckets, [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(good))
    ratios = [math.log(g) - math.log(r) + shift for g, r in zip(good, raw)]
    return ratios, [x - math.log(g) + math.log(max(g - 1, 1)) for x, g in zip(ratios, good)]


def scores(ratios: list[float], others: list[float]) -> Column:
    """Mean log ratios of the document's n-grams by both tables (`score`, `other`); 0 without any."""
    tables = [F.from_json(F.lit(json.dumps(t)), "array<double>") for t in (ratios, others)]  # constants of the plan
    mean = lambda g, t: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(t, b)) / F.size(g)
    both = let(_grams(len(ratios)), lambda g: F.struct(mean(g, tables[0]).alias("score"), mean(g, tables[1]).alias("other")))
    return F.when(F.size("__w") > 0, both).otherwise(F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("other")))


def least_score(scored: DataFrame, trusted: DataFrame, n_trusted: int, deviations: float) -> float:
    """mean - `deviations` standard deviations of the trusted documents' scores (doc_id, other)."""
    own = scored.join(small(trusted, n_trusted, 24), "doc_id", "left_semi")
    # sums of millionths: the same in any order of the rows
    s = F.round(F.col("other") * 1e6).cast("decimal(18,0)")
    m = own.agg(F.count("*").alias("n"), F.sum(s).alias("a"), F.sum(s * s).alias("b")).first()
    if not m["n"]:
        return -math.inf
    mean = float(m["a"]) / m["n"]
    return (mean - deviations * math.sqrt(max(0.0, float(m["b"]) / m["n"] - mean * mean))) / 1e6


def _trusted(trusted: DataFrame) -> tuple[DataFrame, int]:
    trusted = trusted.select("doc_id").where("doc_id is not null").distinct()
    return trusted, trusted.count()


def report(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, score, kept."""
    trusted, n = _trusted(trusted)
    work = _prepared(docs.select("doc_id", "text"), "text")
    tables = fit(work, trusted, n, buckets)
    out = staged(base(work).withColumn("s", scores(*tables)).select("*", "s.*").drop("text", "__t", "__w", "__h", "s"))
    least = least_score(out, trusted, n, deviations)
    return out.drop("other").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def keep(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, deviations: float = DEVIATIONS) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names."""
    names = docs.columns
    trusted, n = _trusted(trusted)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text")
    work = _prepared(rows, "text")
    tables = fit(work.drop("row"), trusted, n, buckets)
    # judged once and written with their rows: filters over the figures would compute them again
    out = staged(base(work).select("row", "doc_id", "base_failed", scores(*tables).alias("s")).select("row", "doc_id", "base_failed", "s.*"))
    least = least_score(out, trusted, n, deviations)
    return out.where(~F.col("base_failed") & (F.col("score") >= F.lit(least))).select("row.*")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Documents labelled good."""
    return labels.where("quality = 1").select("doc_id")
