"""Column-level helpers: every one is a built-in Spark expression (codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgate.functions import patterns as P


def col(c) -> Column:
    """A column from a name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


def ts_lit(ts) -> Column:
    """A timestamp_ntz literal from a string, or a column passed through."""
    if isinstance(ts, str):
        return F.lit(ts).cast("timestamp_ntz")
    return col(ts)


def minutes(n) -> Column:
    """Day-time interval of ``n`` minutes."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def hours(n) -> Column:
    """Day-time interval of ``n`` hours."""
    return F.make_dt_interval(F.lit(0), F.lit(n))


def days(n) -> Column:
    """Day-time interval of ``n`` days."""
    return F.make_dt_interval(F.lit(n))


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz, independent of the
    session time zone (no conversion through TIMESTAMP)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), col(ts))


def epoch_seconds(ts) -> Column:
    """Seconds since epoch as a double (microsecond precision kept)."""
    return epoch_micros(ts) / F.lit(1_000_000.0)


_TIEBREAK_SHIFT = "100000000000000000000"      # 10^20 > 2^64: room for any long
_LONG_OFFSET = "9223372036854775808"           # 2^63: maps longs onto [0, 2^64)


def order_key(ts, tiebreak) -> Column:
    """(ts, tiebreak) packed into one DECIMAL(38,0) that sorts the same way.

    min/max over it run as hash aggregates with fixed-width buffers (a struct
    key forces a sort-based aggregate); any timestamp of years 1-9999 fits."""
    d = "decimal(38,0)"
    return (epoch_micros(ts).cast(d) * F.lit(_TIEBREAK_SHIFT).cast(d)
            + (col(tiebreak).cast(d) + F.lit(_LONG_OFFSET).cast(d))).cast(d)


def seconds_between(later, earlier) -> Column:
    """Seconds from ``earlier`` to ``later`` (double, microsecond precision)."""
    return epoch_seconds(later) - epoch_seconds(earlier)


# ---- B2: masking ----------------------------------------------------------------
# The masked key keeps the first 5 and the last 4 characters.
KEY_KEEP_HEAD, KEY_KEEP_TAIL, KEY_MASK_MIDDLE = 5, 4, "****-****-****-"


def mask_key(c, middle: str = KEY_MASK_MIDDLE) -> Column:
    """Key masked to its first 5 and last 4 characters."""
    c = col(c)
    return F.concat(F.substring(c, 1, KEY_KEEP_HEAD), F.lit(middle),
                    F.substring(c, -KEY_KEEP_TAIL, KEY_KEEP_TAIL))


def mask_email(c) -> Column:
    """First character kept, rest of the local part starred: a***@host."""
    return F.regexp_replace(col(c), r"^(.).+@", "$1***@")


def redact_email(c) -> Column:
    """Whole local part starred: ***@host."""
    return F.regexp_replace(col(c), r"^.+@", "***@")


def mask_url_secret(c) -> Column:
    """A long hex path segment (a secret in key-server URLs) → /***/."""
    return F.regexp_replace(col(c), r"/[a-f0-9-]{30,}/", "/***/")


# ---- B3: platform from user agent -------------------------------------------------
def classify_platform(ua) -> Column:
    """desktop / android / unknown from a user-agent string."""
    ua = F.coalesce(col(ua), F.lit(""))
    return (F.when(ua.contains("Electron"), "desktop")
            .when(ua.contains("Android"), "android").otherwise("unknown"))


# ---- B14: route label -------------------------------------------------------------
def normalize_route(route) -> Column:
    """Route label without its query string; ``unmatched`` when missing."""
    return F.coalesce(F.regexp_replace(col(route), r"\?.*$", ""), F.lit(P.UNMATCHED_ROUTE))


# ---- K10/K11: link resolution --------------------------------------------------------
def strip_hash_query(href) -> Column:
    """Text before the first '#', then before the first '?'."""
    return F.split(F.split(col(href), "#", 2).getItem(0), r"\?", 2).getItem(0)


def is_external(clean) -> Column:
    """True for http(s), protocol-relative, mailto: and tel: targets."""
    clean = col(clean)
    return (clean.startswith("http") | clean.startswith("mailto:")
            | clean.startswith("tel:") | clean.startswith("//"))


def page_dir(path) -> Column:
    """Directory part of a site path: '/a/b.html' → '/a'."""
    return F.regexp_replace(col(path), r"/[^/]*$", "")


def normalize_path(p) -> Column:
    """Collapse '.', '..' and empty segments of an absolute path (like path.join)."""
    segs = F.split(col(p), "/")
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == ".") | (s == ""), acc)
        .otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def resolve_target(clean, base_dir) -> Column:
    """Absolute site path a cleaned href points to (root-relative or relative to the page)."""
    clean = col(clean)
    return normalize_path(F.when(clean.startswith("/"), clean)
                          .otherwise(F.concat(col(base_dir), F.lit("/"), clean)))


def candidate_paths(target) -> Column:
    """The three files a target may be served from: as is, '.html', '/index.html'."""
    t = col(target)
    return F.array(t, F.concat(t, F.lit(".html")),
                   F.concat(F.regexp_replace(t, "/$", ""), F.lit("/index.html")))


def url_path(url) -> Column:
    """Path part of an absolute URL (or the input when it is already a path)."""
    u = col(url)
    p = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"),
                  F.when(p == "", F.lit("/")).otherwise(p)).otherwise(
        F.regexp_extract(u, r"^([^?#]*)", 1))


# ---- text ------------------------------------------------------------------------
WS = r"[ \t\n\r\f]"


def trim_ws(c) -> Column:
    """Trim all ASCII whitespace (Spark's trim() only removes spaces)."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+$", "")


def word_count(c) -> Column:
    """Number of whitespace-separated words (ASCII whitespace)."""
    return F.size(F.regexp_extract_all(col(c), F.lit(r"([^ \t\n\r\f]+)"), 1))


def literal_rows(spark, rows, schema: str):
    """A small parameter table built from literals on the JVM side (a local
    relation: no Python RDD, no job to read it).  ``schema`` is a DDL string."""
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(*names)
