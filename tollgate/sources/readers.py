"""Sources and sinks: page corpora, locale JSON, access-log
text, billing webhook envelopes, the audit-log sink, additive schema change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# A2: HTML corpus from a directory tree
# ---------------------------------------------------------------------------


def load_pages(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """One row per file under ``root`` (recursively): (page_id, path, url, html).
    ``path`` is relative to ``root`` with a leading '/'; ``page_id`` is a hash of
    it, so it is stable across runs and partitions."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
          .text(root, wholetext=True).select(F.col("value").alias("html"),
                                             F.col("_metadata.file_path").alias("_file")))
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("_file", r"^file:", ""), "^" + _re_escape(base), "")
    return df.select(F.xxhash64(rel).alias("page_id"), rel.alias("path"), rel.alias("url"), "html")


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


# ---------------------------------------------------------------------------
# A3: nested JSON -> (id, key, value) leaves
# ---------------------------------------------------------------------------

def flatten_json(df: DataFrame, id_cols, json_col: str, depth: int = 2) -> DataFrame:
    """Leaves of a JSON object column up to ``depth`` levels, as dotted keys and
    text values (locale files are two levels deep).  Arrays are leaves, as JSON
    text; a document that is no JSON object gives one row with a NULL key and
    ``malformed`` true.  Uses VARIANT and the built-in lateral
    ``variant_explode_outer``; no Python."""
    ids = ", ".join(f"`{c}`" for c in id_cols)
    spark = df.sparkSession
    objects = "if(schema_of_variant(%s) LIKE 'OBJECT%%', %s, NULL)"
    lvl = "try_parse_json(`%s`)" % json_col
    lvl = objects % (lvl, lvl)
    joins, keys = [], []
    prev = lvl
    for i in range(1, depth + 1):
        joins.append(f"LATERAL variant_explode_outer({prev}) AS e{i}")
        keys.append(f"e{i}")
        prev = objects % (f"e{i}.value", f"e{i}.value")
    # the leaf is the deepest level that exploded; its key is the dotted path
    cases_key, cases_val = [], []
    for i in range(depth, 0, -1):
        path = " || '.' || ".join(f"e{j}.key" for j in range(1, i + 1))
        cases_key.append(f"WHEN e{i}.key IS NOT NULL THEN {path}")
        cases_val.append(f"WHEN e{i}.key IS NOT NULL THEN cast(e{i}.value AS string)")
    sql = (f"SELECT {ids}, CASE {' '.join(cases_key)} END AS key, CASE {' '.join(cases_val)} END AS value, "
           f"{lvl} IS NULL AS malformed "
           f"FROM {{src}}, {', '.join(joins)}")
    out = spark.sql(sql, src=df)
    return out.filter(F.col("key").isNotNull() | F.col("malformed"))


def flatten_locales(locales: DataFrame, depth: int = 2) -> DataFrame:
    """A3: (lang, json) locale files -> (lang, key, value); malformed files give no rows."""
    return flatten_json(locales, ["lang"], "json", depth).filter("not malformed").drop("malformed")


# ---------------------------------------------------------------------------
# A4: access-log lines
# ---------------------------------------------------------------------------
# Fixed value: the line layout '[i<instance>] [<request id>] <METHOD> <path> <status> <N>ms ip=<ip>'.
ACCESS_LOG_RE = r"^\[i([^\]]*)\] \[([^\]]*)\] ([A-Z]+) (\S+) (\d{3}) (\d+)ms ip=(\S*)$"


def render_access_log(log: DataFrame) -> DataFrame:
    """The text lines a request log would have produced (for round-trip tests)."""
    line = F.concat(F.lit("[i"), F.col("instance").cast("string"), F.lit("] ["), F.col("req_id"),
                    F.lit("] "), F.col("method"), F.lit(" "), F.col("path"), F.lit(" "),
                    F.col("status").cast("string"), F.lit(" "), F.col("duration_ms").cast("string"),
                    F.lit("ms ip="), F.col("ip"))
    return log.select(line.alias("value"))


def parse_access_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """A4: parse text lines into columns; lines that do not match give NULLs
    (``try_cast`` keeps ANSI mode from failing on dirty text)."""
    c = F.col(col)

    def g(i):
        return F.regexp_extract(c, ACCESS_LOG_RE, i)
    ok = c.rlike(ACCESS_LOG_RE)
    return lines.select(
        F.when(ok, g(1)).alias("instance"), F.when(ok, g(2)).alias("req_id"),
        F.when(ok, g(3)).alias("method"), F.when(ok, g(4)).alias("path"),
        F.when(ok, g(5)).try_cast("int").alias("status"),
        F.when(ok, g(6)).try_cast("long").alias("duration_ms"), F.when(ok, g(7)).alias("ip"))


# ---------------------------------------------------------------------------
# A5: billing webhook envelopes
# ---------------------------------------------------------------------------
_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("id", _S), T.StructField("type", _S), T.StructField("created", _L),
    T.StructField("data", T.StructType([T.StructField("object", T.StructType([
        T.StructField("id", _S), T.StructField("customer", _S), T.StructField("subscription", _S),
        T.StructField("customer_email", _S),
        T.StructField("customer_details", T.StructType([T.StructField("email", _S)])),
        T.StructField("metadata", T.StructType([T.StructField("plan", _S)])),
        T.StructField("billing_reason", _S),
        T.StructField("lines", T.StructType([T.StructField("data", T.ArrayType(T.StructType([
            T.StructField("period", T.StructType([T.StructField("end", _L)]))])))])),
        T.StructField("amount", _D), T.StructField("amount_refunded", _D), T.StructField("invoice", _S),
        T.StructField("cancel_at_period_end", _B), T.StructField("status", _S),
    ]))])),
])
# Webhook event types and the operation names used here.
EVENT_KINDS = {
    "checkout.session.completed": "checkout_completed",
    "invoice.payment_succeeded": "payment_succeeded",
    "invoice.payment_failed": "payment_failed",
    "customer.subscription.deleted": "subscription_deleted",
    "customer.subscription.updated": "subscription_updated",
    "charge.refunded": "charge_refunded",
}


def _kind(t):
    expr = F.lit(None).cast("string")
    for k, v in EVENT_KINDS.items():
        expr = F.when(t == k, v).otherwise(expr)
    return expr


def parse_billing_events(raw: DataFrame, col: str = "value") -> DataFrame:
    """A5: webhook JSON -> one flat event row.  The e-mail comes from the
    customer details or the session; the period end from the first invoice line;
    the subscription from the object (or the object id for subscription events)."""
    e = F.from_json(F.col(col), ENVELOPE_SCHEMA).alias("e")
    o = "e.data.object"
    t = F.col("e.type")
    is_sub = t.startswith("customer.subscription.")
    return raw.select(e).select(
        F.col("e.id").alias("event_id"), _kind(t).alias("kind"),
        F.timestamp_seconds(F.col("e.created")).cast("timestamp_ntz").alias("ts"),
        F.when(is_sub, F.col(f"{o}.id")).otherwise(F.col(f"{o}.subscription")).alias("subscription_id"),
        F.col(f"{o}.invoice").alias("invoice_id"), F.col(f"{o}.customer").alias("customer_id"),
        F.when(t.startswith("checkout."), F.col(f"{o}.id")).alias("session_id"),
        F.coalesce(F.col(f"{o}.customer_details.email"), F.col(f"{o}.customer_email")).alias("email"),
        F.col(f"{o}.metadata.plan").alias("plan"),
        F.col(f"{o}.billing_reason").alias("billing_reason"),
        F.timestamp_seconds(F.col(f"{o}.lines.data").getItem(0)["period"]["end"]).cast("timestamp_ntz")
        .alias("period_end"),
        F.col(f"{o}.amount").alias("amount"), F.col(f"{o}.amount_refunded").alias("amount_refunded"),
        F.col(f"{o}.cancel_at_period_end").alias("cancel_at_period_end"),
        F.col(f"{o}.status").alias("sub_status"), F.col(o).isNull().alias("broken"))


def render_billing_events(ev: DataFrame) -> DataFrame:
    """Webhook envelopes for flat billing events (the inverse of A5, for tests
    and replay).  ``created`` is whole seconds, as the payment service sends."""
    inv = {v: k for k, v in EVENT_KINDS.items()}
    typ = F.lit(None).cast("string")
    for k, v in inv.items():
        typ = F.when(F.col("kind") == k, v).otherwise(typ)
    is_sub = F.col("kind").startswith("subscription_")
    sub = F.col("subscription_id").cast("string")
    have = set(ev.columns)

    def maybe(name):
        return F.col(name) if name in have else F.lit(None).cast("string")
    obj = F.struct(
        F.when(is_sub, sub).otherwise(F.concat(F.lit("obj_"), F.col("event_id").cast("string"))).alias("id"),
        F.when(~is_sub, sub).alias("subscription"), maybe("invoice_id").alias("invoice"),
        maybe("customer_id").alias("customer"), maybe("email").alias("customer_email"),
        maybe("billing_reason").alias("billing_reason"), F.struct(maybe("plan").alias("plan")).alias("metadata"),
        F.col("amount").alias("amount"), F.col("amount_refunded").alias("amount_refunded"),
        F.col("cancel_at_period_end").alias("cancel_at_period_end"), F.col("sub_status").alias("status"),
        F.struct(F.array(F.struct(F.struct(F.unix_seconds(F.col("period_end").cast("timestamp")).alias("end"))
                                  .alias("period"))).alias("data")).alias("lines")
        if "period_end" in have else F.lit(None).alias("lines"))
    if "broken" in have:  # an envelope without its object
        obj = F.when(~F.col("broken"), obj)
    env = F.struct(F.col("event_id").cast("string").alias("id"), typ.alias("type"),
                   F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"),
                   F.struct(obj.alias("object")).alias("data"))
    return ev.select(F.to_json(env).alias("value"))


# ---------------------------------------------------------------------------
# Audit-log sink
# ---------------------------------------------------------------------------

def audit_rows(decisions: DataFrame, action: str = "action", entity_type: str = "entity_type",
               entity_id: str = "entity_id", details: str = "details", ts: str = "ts") -> DataFrame:
    """Decisions projected to audit-log rows with a date partition column."""
    return decisions.select(F.col(action).alias("action"), F.col(entity_type).alias("entity_type"),
                            F.col(entity_id).cast("string").alias("entity_id"),
                            F.col(details).alias("details"), F.col(ts).alias("created_at"),
                            F.to_date(F.col(ts)).alias("date"))


def append_audit(rows: DataFrame, path: str, run: str | None = None, batch: int = 0) -> None:
    """Append to the audit table, partitioned by date (readers prune by date).

    With ``run`` (a job's or stream's id) and ``batch`` the append is idempotent: the rows go to
    the folder of that run and batch, and a batch that is written again replaces it.  Read such a
    table with :func:`read_audit`."""
    # one writer per date (AQE splits a large one), so an append leaves few files
    rows = rows.hint("rebalance", "date")
    if run is None:
        rows.write.mode("append").partitionBy("date").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("date").parquet(f"{path}/run={run}/batch={batch:010d}")


def stream_audit(path: str, run: str):
    """foreachBatch function: each micro-batch of audit rows becomes the run's batch of that number."""
    return lambda rows, batch: append_audit(rows, path, run, batch)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of the committed batches of all runs, with ``run`` and ``batch``."""
    from tollgate.sources.folders import complete
    runs = sorted({r for r in complete(spark, path, "run=*/batch=*", parents=1)})
    return spark.read.option("basePath", path).parquet(*[f"{path}/{r}" for r in runs])


# ---------------------------------------------------------------------------
# Additive schema change
# ---------------------------------------------------------------------------

def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Read an older file version under the current schema: columns it lacks
    become typed NULLs, column order follows ``schema``."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A8 over files: the Parquet files under ``path``, written by versions that lack newer columns or
    have more, under the current schema.  Spark merges the footers' schemas; a column that no
    file has is NULL as well, and one that the schema does not name is left out."""
    return align_schema(spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path), schema)
