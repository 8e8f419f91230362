"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join.

A listed entry is (host, path, verdict) in canonical form: host lower-cased, no scheme,
query or fragment.  It fits its host and every subdomain if the url's path starts with its
path; the longest fitting entry (host and path together, then the longer host) decides.
Each url proposes one key per shape (labels in the host, length of the path) that occurs in
the list.  Keys the Bloom filter refuses end there, without a shuffle; the rest meet the list
in an exact join, which removes false positives.  Unlisted urls get `default`.

Defined results: null urls and urls without "://" have empty host and path and fit nothing;
repeated pages give repeated rows; of equal entries with different verdicts "block" wins;
an empty list gives every page the default; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm import bloom
from tollgate.llm.common import ascii_lower


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first "://" to "/", "?", "#" or the end; path: on to "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url))
    pages = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = (listed.groupBy(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
             .agg(F.max("verdict").alias("r_verdict"), F.max(F.size(F.split("host", r"\."))).alias("labels")))
    # the shapes in the list: a few numbers of labels times a few hundred path lengths at most
    shapes = [tuple(r) for r in rules.select("labels", F.length("r_path")).distinct().orderBy("labels", "length(r_path)").collect()]
    if not shapes:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = bloom.geometry(rules.count())
    filt = bloom.build(rules, F.xxhash64("r_host", "r_path"), blocks)

    # one constant array, however many shapes: the plan does not grow with the list
    known = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in shapes])), "array<struct<k:int,n:int>>")
    n_labels = F.size(F.split("host", r"\."))
    fitting = F.filter(known, lambda s: (s["k"] <= n_labels) & (s["n"] <= F.length("path")))
    keys = F.transform(fitting, lambda s: F.struct(
        F.call_function("substring_index", F.col("host"), F.lit("."), -s["k"]).alias("r_host"),
        F.substring(F.col("path"), F.lit(1), s["n"]).alias("r_path")))
    urls = pages.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one"))
    tried = urls.select("host", "path", F.explode(keys).alias("k"))
    tried = tried.select("host", "path", "k.*")
    maybe = bloom.probe(tried, F.xxhash64("r_host", "r_path"), filt, blocks).where("maybe")
    rank = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), "r_host", "r_path")
    found = (maybe.join(rules, ["r_host", "r_path"]).groupBy("host", "path")
             .agg(F.max(F.struct(rank.alias("rank"), F.concat("r_host", "r_path").alias("rule"), "r_verdict")).alias("r")))
    # joined on an expression, so both sides are exchanged and AQE can split a very common url
    key = F.concat("host", F.lit("\x00"), "path")
    return (pages.withColumn("k", key)
            .join(found.select(key.alias("k"), F.col("r.rule").alias("rule"), F.col("r.r_verdict").alias("v")), "k", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict")))
