"""Domain-shaped views over the driver tables (FIXTURES.md section 3).

They relabel the synthetic TPC-H-like tables so the operators have licences,
nodes, billing events, request logs and site links to work on.  The SQL text is
written once with ``{table}`` placeholders and rendered for both engines:
Spark binds the placeholders to DataFrames (``spark.sql(text, orders=df)``),
the DuckDB oracle binds them to its pre-registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tollgate.sources.tables import load_table

# Fixed value: the instant the licence operators treat as "now" in the views.
LICENSE_AS_OF = "2000-01-01 00:00:00"

VIEW_SQL: dict[str, str] = {
    "licenses": """
SELECT o_orderkey AS id, 'KEY-' || lpad(cast(o_orderkey AS string), 8, '0') AS key,
 'user' || cast(o_custkey AS string) || '@example.com' AS email,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'pro' ELSE 'basic' END AS plan,
 o_custkey AS customer_id, 'sub_' || cast(o_orderkey AS string) AS subscription_id,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'device-' || lpad(cast(o_custkey AS string), 12, '0') END AS device_id,
 CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'expired'
      WHEN o_orderkey % 2 = 0 THEN 'suspended' ELSE 'cancelled' END AS status,
 o_orderdate AS created_at, o_orderdate + INTERVAL 1 YEAR AS expires_at,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS last_check,
 CASE WHEN o_orderkey % 7 = 0 THEN 'pending' WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey AS string) END AS key_id,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 12 END AS node_id
FROM {orders}""",
    "nodes": """
SELECT s_suppkey AS id, s_nationkey AS region, s_name AS name,
 CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
 CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE 600 + 100 * (s_suppkey % 7) END AS max_keys
FROM {supplier}""",
    "node_keys": """
SELECT DISTINCT l_suppkey % 12 AS node_id, cast(l_orderkey AS string) AS key_id
FROM {lineitem}""",
    "billing_events": """
SELECT event_id, ts, user_id AS subscription_id, value AS amount,
 CASE WHEN event_type = 'signup' THEN 'checkout_completed' WHEN event_type = 'purchase' THEN 'payment_succeeded'
      WHEN event_type = 'error' THEN 'payment_failed' WHEN event_type = 'view' THEN 'subscription_updated'
      WHEN event_id % 25 = 0 THEN 'subscription_deleted' ELSE 'charge_refunded' END AS kind,
 event_id % 3 = 0 AS cancel_at_period_end,
 CASE WHEN event_id % 3 = 1 THEN 'past_due' ELSE 'active' END AS sub_status,
 CASE WHEN event_id % 2 = 0 THEN value ELSE value / 2 END AS amount_refunded
FROM {events}""",
    "request_log": """
SELECT event_id AS request_id, ts, user_id AS client_id, '/' || event_type AS route,
 CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status,
 value / 100.0 AS duration_s
FROM {events}""",
    "request_burst": """
SELECT event_id AS request_id, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 10) AS ts, user_id AS client_id, '/' || event_type AS route
FROM {events}""",
    "device_seen": """
SELECT 'dev-' || cast(event_id % 7 AS string) AS device_id, user_id AS license_id, ts, event_id,
 CASE WHEN event_type = 'view' THEN 'Electron/30' WHEN event_type = 'click' THEN 'okhttp Android 14' ELSE 'curl/8' END AS user_agent,
 '10.0.0.' || cast(event_id % 250 AS string) AS ip
FROM {events}""",
    "device_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id,
 CASE WHEN l_suppkey % 13 = 0 THEN 'bad key' WHEN l_suppkey % 17 = 0 THEN 'KEY-99999999'
      ELSE 'KEY-' || lpad(cast(l_orderkey AS string), 8, '0') END AS key,
 'device-' || lpad(cast(o_custkey + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END AS string), 12, '0') AS device_id,
 l_shipdate AS ts
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "sessions": """
SELECT o_orderkey AS session_id,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'sub_none' ELSE 'sub_' || cast(o_orderkey AS string) END AS subscription_id,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey END AS customer_id,
 o_orderkey % 6 <> 5 AS paid
FROM {orders}""",
    "claim_events": """
SELECT event_id, user_id % 20 AS license_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'claim' ELSE 'complete' END AS kind
FROM {events}""",
    "retry_queue": """
SELECT event_id AS id, user_id AS license_id, cast(event_id % 5 AS int) AS attempts,
 ts + INTERVAL 5 MINUTE AS next_retry, ts AS created_at, event_id % 4 = 0 AS send_ok
FROM {events} WHERE event_type = 'error'""",
    "site_paths": """
SELECT page_id, '/p/' || cast(page_id AS string) || CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN '.html' ELSE '/index.html' END AS path
FROM {pages}""",
    "site_links": """
SELECT page_id, CASE WHEN slot = 5 THEN 'mailto:a@example.com' WHEN slot = 4 THEN 'https://other.example.com/x'
      WHEN (slot = 3 AND page_id % 7 = 0) OR (slot = 2 AND page_id % 14 = 0) THEN '/gone/' || cast(page_id AS string) || '.html'
      ELSE '/p/' || cast((page_id % n_pages * (page_id % n_pages % 1000003) + slot * 13) % n_pages AS string) ||
           CASE WHEN slot = 0 THEN '' WHEN slot = 1 THEN '#top' ELSE '?utm=1' END END AS href
FROM (SELECT page_id, (SELECT count(*) FROM {pages}) AS n_pages, unnest(range(0, 6)) AS slot FROM {pages}) t""",
}

# Derived inputs for operators whose input the views above do not carry.  They
# are relabellings of the same tables, written once and run by both engines.
VIEW_SQL.update({
    "billing_events_ext": """
SELECT *,
 CASE WHEN kind = 'payment_succeeded' AND event_id % 2 = 0 THEN ts + INTERVAL 30 DAY END AS period_end,
 CASE WHEN event_id % 4 = 0 THEN 'security_vpn' WHEN event_id % 4 = 1 THEN 'vpn' WHEN event_id % 4 = 2 THEN 'vpn' ELSE 'legacy' END AS plan
FROM {billing_events}""",
    "transfer_requests": """
SELECT request_id, key, 'new-' || device_id AS device_id, device_id AS current_device_id, ts
FROM {device_requests}""",
    "transfer_licenses": """
SELECT id, key, status, device_id, last_check AS last_transfer_at, key_id, node_id
FROM {licenses}""",
    "refunds": """
SELECT l_orderkey * 10 + l_linenumber AS charge_id,
 CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_orderkey END AS invoice_id,
 l_extendedprice AS amount,
 CASE WHEN l_discount > 0.05 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END AS amount_refunded
FROM {lineitem} WHERE l_returnflag = 'R'""",
    "invoices": """
SELECT o_orderkey AS invoice_id,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'sub_' || cast(o_orderkey + CASE WHEN o_custkey % 5 = 0 THEN 1000000000 ELSE 0 END AS string) END AS subscription_id
FROM {orders}""",
    "subscriptions": """
SELECT 'sub_' || cast(o_orderkey AS string) AS subscription_id,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'past_due' WHEN o_orderstatus = 'P' THEN 'trialing'
      WHEN o_orderstatus = 'O' THEN 'active' ELSE 'canceled' END AS status
FROM {orders}""",
    "checkouts": """
SELECT session_id, CASE WHEN subscription_id = 'sub_none' THEN 'sub_new_' || cast(customer_id % 50 AS string) ELSE subscription_id END AS subscription_id,
 customer_id, CASE WHEN session_id % 5 = 0 THEN 'legacy' WHEN session_id % 2 = 0 THEN 'security_vpn' ELSE 'vpn' END AS plan
FROM {sessions}""",
    "access_log_rows": """
SELECT cast(client_id % 2 AS string) AS instance, 'r' || cast(request_id AS string) AS req_id,
 CASE WHEN route = '/view' THEN 'GET' ELSE 'POST' END AS method, '/api' || route AS path, status,
 cast(floor(abs(duration_s) * 1000) AS bigint) AS duration_ms,
 '10.0.' || cast(client_id % 250 AS string) || '.' || cast(request_id % 250 AS string) AS ip
FROM {request_log}""",
    "billing_raw": """
SELECT event_id, date_trunc('second', ts) AS ts, kind,
 CASE WHEN kind = 'charge_refunded' OR (kind IN ('payment_succeeded', 'payment_failed') AND event_id % 13 = 0) OR (kind = 'checkout_completed' AND event_id % 5 = 0) THEN NULL ELSE subscription_id END AS subscription_id,
 CASE WHEN kind = 'charge_refunded' AND event_id % 10 <> 0 THEN cast(event_id AS string) END AS invoice_id,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'user' || cast(subscription_id AS string) || '@example.com' END AS email,
 CASE WHEN event_id % 6 = 0 THEN 'subscription_create' ELSE 'subscription_cycle' END AS billing_reason,
 CASE WHEN event_id % 40 = 0 THEN NULL ELSE 'cus_' || cast(subscription_id * 3 + event_id % 3 AS string) END AS customer_id, plan, amount, amount_refunded, cancel_at_period_end, sub_status,
 event_id % 31 = 0 AS broken, date_trunc('second', period_end) AS period_end
FROM {billing_events_ext}""",
    "billing_invoices": """
SELECT cast(event_id AS string) AS invoice_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE subscription_id END AS subscription_id
FROM {billing_events_ext} WHERE kind = 'charge_refunded'""",
    "billing_subscriptions": """
SELECT DISTINCT cast(subscription_id AS string) AS subscription_id,
 CASE WHEN subscription_id % 9 = 0 THEN 'canceled' WHEN subscription_id % 9 = 1 THEN 'trialing' ELSE 'active' END AS status
FROM {billing_events}""",
    "price_facts": """
SELECT o_orderkey, o_orderdate AS ts,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'security_vpn' WHEN o_orderpriority = '5-LOW' THEN 'trial' ELSE 'vpn' END AS plan
FROM {orders}""",
})

# Structured data of four shapes, with JSON escapes, beside the questions that a page shows.
VIEW_SQL["faq_pages"] = """
SELECT page_id, url, '<html><h2 class="faq-question">Is it "fast" & caf\u00e9-proof?</h2><p class="faq-answer">Yes: a/b, tab.</p>' ||
 CASE WHEN page_id % 3 = 0 THEN '<h3 class="faq-question">Only shown ' || id || '</h3>' ELSE '' END || '<script type="application/ld+json">' ||
 CASE page_id % 5 WHEN 0 THEN q WHEN 1 THEN '{{"@context": "x", "@graph": [{{"@type": "Thing", "name": "no"}}, ' || q || ']}}'
  WHEN 2 THEN '[' || q || ', {{"@type": "Article", "name": "no"}}]' WHEN 3 THEN '{{"@graph": [{{"@graph": [' || q || ']}}]}}'
  ELSE '{{"@type": "FAQPage", "mainEntity": [' END || '</script></html>' AS html
FROM (SELECT page_id, url, cast(page_id AS string) AS id, '{{"@type": "FAQPage", "mainEntity": ' || CASE WHEN page_id % 2 = 0 THEN '' ELSE '[' END ||
  '{{"@type": "Question", "name": "Is it \\"fast\\" \\u0026 caf\\u00e9-proof?", "acceptedAnswer": {{"@type": "Answer", "text": "Yes: a\\/b, tab."}}}}' ||
  CASE WHEN page_id % 2 = 0 THEN '' ELSE ', {{"@type": "Question", "name": "Only marked ' || cast(page_id AS string) || '", "acceptedAnswer": {{"@type": "Answer", "text": "x"}}}}]' END || '}}' AS q
 FROM {pages}) t"""

# A site whose pages differ in every audited feature: head tags, structured data,
# language links, FAQ blocks, buttons and assets, around the article of each page.
_H = "https://www.example.com"
VIEW_SQL["site_pages"] = f"""
SELECT page_id, '{_H}' || path AS url,
 CASE WHEN page_id % 13 = 0 THEN '' ELSE '<!DOCTYPE html>' END ||
 CASE WHEN page_id % 11 = 0 THEN '<html>' ELSE '<html lang="' || lang || '"' || CASE WHEN m = 1 AND k = 0 THEN ' dir="rtl"' WHEN k = 0 THEN ' dir="ltr"' ELSE '' END || '>' END || '<head>' ||
 CASE WHEN page_id % 9 = 0 THEN '' ELSE '<meta charset="UTF-8">' END ||
 CASE WHEN page_id % 7 = 0 THEN '' ELSE '<meta name="viewport" content="width=device-width">' END ||
 CASE WHEN page_id % 6 = 0 THEN '' ELSE '<title> Page ' || id || ' </title>' END ||
 CASE WHEN page_id % 5 = 1 THEN '' ELSE '<meta name="description" content="About page ' || id || '">' END ||
 CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<link rel="canonical" href="{_H}/other">' ELSE '<link rel="canonical" href="{_H}' || path || '">' END ||
 CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '<meta property="og:title" content="T"><meta property="og:locale" content="fr_FR">'
  ELSE '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:url" content="U"><meta property="og:type" content="article"><meta property="og:site_name" content="S"><meta property="og:image" content="I"><meta property="og:locale" content="' || lang || '"><meta name="twitter:card" content="C"><meta name="twitter:title" content="T"><meta name="twitter:description" content="D"><meta name="twitter:image" content="I">' END ||
 CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<script type="application/ld+json">{{{{"@type": "Article", </script>'
  WHEN 2 THEN '<script type="application/ld+json">{{{{"@type": "Article", "inLanguage": "en"}}}}</script>'
  WHEN 3 THEN '<script type="application/ld+json">{{{{"@graph": [{{{{"@type": "FAQPage", "mainEntity": [{{{{"@type": "Question", "name": "What is it?", "acceptedAnswer": {{{{"@type": "Answer", "text": "An article."}}}}}}}}]}}}}, {{{{"@type": "BreadcrumbList"}}}}]}}}}</script>'
  ELSE '<script type="application/ld+json">{{{{"@type": "Thing", "about": {{{{"@type": "Article", "inLanguage": "' || lang || '"}}}}}}}}</script>' END ||
 CASE WHEN m > 2 THEN '' ELSE '<link rel="alternate" hreflang="en" href="{_H}/p' || b || '/index.html">' ||
  CASE WHEN k = 0 THEN '<link rel="alternate" hreflang="ar" href="{_H}/ar/p' || b || '/index.html"><link rel="alternate" hreflang="fr" href="{_H}/fr/p' || b || '/index.html">' ELSE '' END ||
  CASE WHEN k = 0 THEN '<link rel="alternate" hreflang="x-default" href="{_H}/p' || b || '/index.html"><link rel="alternate" hreflang="hi" href="{_H}/hi/p' || b || '/index.html"><link rel="stylesheet" href="/css/rtl.css">' ELSE '' END END ||
 CASE WHEN m = 7 AND k = 0 THEN '<meta name="robots" content="noindex">' ELSE '' END || '</head><body data-promo-end="2024-01-0' || cast(page_id % 3 + 1 AS string) || '">' ||
 CASE page_id % 4 WHEN 2 THEN '<h2 class="faq-question">What is it?</h2><p class="faq-answer">' || CASE WHEN page_id % 3 = 0 THEN 'A page.' ELSE 'An article.' END || '</p>' WHEN 3 THEN '<h2 class="faq-question"> Who? </h2>' ELSE '' END ||
 CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN '<a onclick="startCheckout(''vpn'')">Buy</a>' ELSE '<a onclick="startCheckout(''gold'')">Buy</a><a onclick="startCheckout(''security_vpn'')">Buy</a>' END ||
 CASE WHEN m = 6 AND k = 0 THEN '<a href="/downloads/app">Get</a>' ELSE '' END ||
 CASE WHEN m = 3 AND k = 0 THEN '<a href="/compare/c' || cast(page_id + 1 AS string) || '.html">Compare</a>' ELSE '' END ||
 CASE WHEN m IN (1, 2) THEN '<a href="/p' || b || '/index.html#top">Home</a>' ELSE '' END ||
 CASE WHEN page_id % 4 = 0 THEN '' ELSE '<img src="/img/a.png?v=' || cast(page_id % 2 AS string) || '" srcset="/img/a.png 1x, /img/b.png 2x">' END ||
 '<p data-i18n="src' || cast(page_id % 30 AS string) || '">' || substr(html, instr(html, '<article>')) AS html
FROM (SELECT page_id, html, lang, id, b, m, k, CASE m WHEN 0 THEN '/p' || b || '/index.html' WHEN 1 THEN '/ar/p' || b || '/index.html' WHEN 2 THEN '/fr/p' || b || '/index.html'
   WHEN 3 THEN '/blog/a' || id || '.html' WHEN 4 THEN '/compare/c' || id || '.html' WHEN 5 THEN '/pricing-' || id || '.html'
   WHEN 6 THEN '/download-' || id || '.html' ELSE '/x' || b || '/404.html' END AS path
  FROM (SELECT page_id, html, page_id % 8 AS m, page_id % 16 - page_id % 8 AS k, cast(page_id AS string) AS id, cast(page_id - page_id % 8 AS string) AS b,
    CASE page_id % 8 WHEN 1 THEN 'ar' WHEN 2 THEN 'fr' ELSE 'en' END AS lang FROM {{pages}}) x) y"""

# Spark text where it differs from the shared one: the six link slots of a page.
SPARK_VIEW_SQL: dict[str, str] = {
    "site_links": VIEW_SQL["site_links"].replace("unnest(range(0, 6))", "explode(sequence(0, 5))"),
}
SPARK_VIEW_SQL["request_burst"] = VIEW_SQL["request_burst"].replace(
    "TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 10)", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(event_id AS decimal(18, 6)) / 100)")
SPARK_VIEW_SQL["faq_pages"] = VIEW_SQL["faq_pages"].replace("\\", "\\\\")  # Spark reads escapes in literals
SPARK_VIEW_DEPS: dict[str, tuple[str, ...]] = {"site_links": ("pages",), "faq_pages": ("pages",), "request_burst": ("events",)}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "licenses": ("orders",), "nodes": ("supplier",), "node_keys": ("lineitem",),
    "billing_events": ("events",), "request_log": ("events",), "request_burst": ("events",), "device_seen": ("events",),
    "device_requests": ("lineitem", "orders"), "sessions": ("orders",),
    "retry_queue": ("events",), "claim_events": ("events",), "site_paths": ("pages",), "site_pages": ("pages",), "faq_pages": ("pages",), "site_links": ("pages",),
    "billing_events_ext": ("billing_events",), "transfer_requests": ("device_requests",),
    "transfer_licenses": ("licenses",), "refunds": ("lineitem",), "invoices": ("orders",),
    "subscriptions": ("orders",), "checkouts": ("sessions",), "price_facts": ("orders",),
    "access_log_rows": ("request_log",), "billing_raw": ("billing_events_ext",),
    "billing_invoices": ("billing_events_ext",), "billing_subscriptions": ("billing_events",),
}

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_view_sql(name: str) -> str:
    """View text with placeholders bound to the oracle's table / CTE names."""
    return VIEW_SQL[name].format(**{t: t for t in VIEW_DEPS[name]})


def view_closure(names) -> list[str]:
    """Views needed by ``names``, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in out or n not in VIEW_SQL:
            return
        for d in VIEW_DEPS[n]:
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


class Catalog:
    """Lazy access to the tables and views of one scale-factor folder.

    The DataFrames (plans, not data) are memoised per session and folder, so a
    view shared by many queries is parsed and analysed once per process."""

    _memo: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _key(self, kind: str, name: str):
        return (self.spark.sparkContext.applicationId, id(self.spark), self.sf_dir, kind, name)

    def table(self, name: str) -> DataFrame:
        k = self._key("table", name)
        if k not in Catalog._memo:
            Catalog._memo[k] = load_table(self.spark, self.sf_dir, name)
        return Catalog._memo[k]

    def view(self, name: str) -> DataFrame:
        k = self._key("view", name)
        if k not in Catalog._memo:
            text = SPARK_VIEW_SQL.get(name, VIEW_SQL[name])
            names = SPARK_VIEW_DEPS.get(name, VIEW_DEPS[name])
            deps = {t: (self.view(t) if t in VIEW_SQL else self.table(t)) for t in names}
            Catalog._memo[k] = self.spark.sql(text, **deps)
        return Catalog._memo[k]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            return self.view(name)
        from tollgate.sources.tables import SCHEMAS
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)
