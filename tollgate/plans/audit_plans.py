"""Registered site-audit queries (K) and their oracles.

Extraction checks run on ``pages``; link resolution runs on ``site_links`` x
``site_paths`` (the links inside ``pages`` never resolve to a page of the table).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.operators import siteaudit as K
from tollgate.plans.registry import register


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = "[ \\t\\n\\r\\f]"
URL_PATH_SQL = (f"CASE WHEN regexp_matches(url, {sq('^[a-zA-Z][a-zA-Z0-9+.-]*://')}) THEN "
                f"coalesce(nullif(regexp_extract(url, {sq('^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)')}, 1), ''), '/') "
                f"ELSE regexp_extract(url, {sq('^([^?#]*)')}, 1) END")


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, {sq(f'^{WS}+|{WS}+$')}, '', 'g')"


def meta_sql(name: str) -> str:
    return f"regexp_extract(html, {sq(P.meta_pattern(name))}, 1)"


def _links(c):
    """site_links with the linking page's path (for relative resolution)."""
    return c.site_links.join(c.site_paths, "page_id")


RANGES = {"blog": (800, 3000), "compare": (600, 2500), "page": (150, 4000)}


# ---- K1-K9 ------------------------------------------------------------------------------

@register("k1_k2_structure", oracle=f"""
SELECT page_id, {URL_PATH_SQL} AS path, lower(substr(html, 1, 15)) = '<!doctype html>' AS has_doctype,
 regexp_matches(html, {sq(P.RE_HTML_LANG)}) AS has_lang, regexp_extract(html, {sq(P.RE_HTML_LANG_VALUE)}, 1) AS lang,
 regexp_matches(html, {sq(P.RE_CHARSET)}) AS has_charset, regexp_matches(html, {sq(P.RE_VIEWPORT)}) AS has_viewport
FROM pages""", headline=True)
def k1(c):
    return K.audit_pages(c.pages).select("page_id", "path", "has_doctype", "has_lang", "lang",
                                          "has_charset", "has_viewport")


@register("k3_title_description", oracle=f"""
SELECT page_id, {trim_sql(f"regexp_extract(html, {sq(P.RE_TITLE)}, 1)")} AS title,
 length({trim_sql(f"regexp_extract(html, {sq(P.RE_TITLE)}, 1)")}) AS title_len,
 length({meta_sql('description')}) AS desc_len FROM pages""")
def k3(c):
    return K.audit_pages(c.pages).select("page_id", "title", "title_len", "desc_len")


@register("k4_canonical", oracle=f"""
SELECT page_id, regexp_matches(html, {sq(P.RE_CANONICAL)}) AS has_canonical,
 regexp_extract(html, {sq(P.RE_CANONICAL_HREF)}, 1) <> '' AND regexp_extract(html, {sq(P.RE_CANONICAL_HREF)}, 1) = url AS canonical_self
FROM pages""")
def k4(c):
    return K.audit_pages(c.pages).select("page_id", "has_canonical", "canonical_self")


@register("k5_social_tags", oracle="SELECT page_id, " + " + ".join(
    f"CAST(length({meta_sql(t)}) = 0 AS INTEGER)" for t in K.SOCIAL_TAGS) + " AS n_missing_tags FROM pages")
def k5(c):
    return K.audit_pages(c.pages).select("page_id", F.size("missing_tags").alias("n_missing_tags"))


@register("k6_jsonld", oracle=f"""
SELECT page_id, len(regexp_extract_all(html, {sq(P.RE_JSONLD)}, 1)) AS n_jsonld,
 len(list_filter(regexp_extract_all(html, {sq(P.RE_JSONLD)}, 1), lambda b: NOT coalesce(json_valid({trim_sql('b')}), false))) AS n_bad_jsonld
FROM pages""")
def k6(c):
    return K.audit_pages(c.pages).select("page_id", F.size("jsonld").cast("long").alias("n_jsonld"), "n_bad_jsonld")


@register("k7_jsonld_types", oracle=f"""
SELECT page_id, len(list_distinct(flatten(list_transform(regexp_extract_all(html, {sq(P.RE_JSONLD)}, 1),
   lambda b: regexp_extract_all(b, {sq(K.JSONLD_TYPE)}, 1))))) AS n_types,
 len(list_filter(['Article', 'FAQPage', 'BreadcrumbList'], lambda t: NOT list_contains(
   flatten(list_transform(regexp_extract_all(html, {sq(P.RE_JSONLD)}, 1), lambda b: regexp_extract_all(b, {sq(K.JSONLD_TYPE)}, 1))), t))) AS n_missing_types
FROM pages""")
def k7(c):
    t = K.jsonld_types(K.audit_pages(c.pages))
    return t.select("page_id", F.size("types").cast("long").alias("n_types"),
                    F.size("missing_types").cast("long").alias("n_missing_types"))


@register("k8_links", oracle=f"""
SELECT DISTINCT page_id, unnest(regexp_extract_all(html, {sq(P.RE_HREF)}, 1)) AS href FROM pages""")
def k8(c):
    return K.page_links(K.audit_pages(c.pages)).select("page_id", "href")


@register("k9_assets", oracle=f"""
SELECT page_id, len(regexp_extract_all(html, {sq(P.RE_SRC)}, 1)) + len(list_filter(list_transform(
   flatten(list_transform(regexp_extract_all(html, {sq(P.RE_SRCSET)}, 1), lambda s: string_split(s, ','))),
   lambda p: regexp_split_to_array({trim_sql('p')}, {sq(WS + '+')})[1]), lambda u: u <> '')) AS n_assets
FROM pages""")
def k9(c):
    return K.audit_pages(c.pages).select("page_id", F.size("assets").cast("long").alias("n_assets"))


# ---- K10-K12, K18, K19, K23, K24: links -------------------------------------------------------
_TARGETS_SQL = """t AS (SELECT DISTINCT page_id, href, clean AS target FROM (
   SELECT page_id, href, split_part(split_part(href, '#', 1), '?', 1) AS clean FROM site_links) c
  WHERE clean <> '' AND NOT (starts_with(clean, 'http') OR starts_with(clean, 'mailto:')
   OR starts_with(clean, 'tel:') OR starts_with(clean, '//'))
   AND NOT starts_with(clean, '/downloads/') AND NOT starts_with(clean, '/api/')),
r AS (SELECT t.*, coalesce(p1.page_id, p2.page_id, p3.page_id) AS dst_page_id FROM t
  LEFT JOIN site_paths p1 ON p1.path = t.target
  LEFT JOIN site_paths p2 ON p2.path = t.target || '.html'
  LEFT JOIN site_paths p3 ON p3.path = regexp_replace(t.target, '/$', '') || '/index.html')"""


@register("k10_broken_links", views=("site_links", "site_paths"), headline=True, oracle=f"""
WITH {_TARGETS_SQL}
SELECT page_id, href, target FROM r WHERE dst_page_id IS NULL""")
def k10(c):
    return K.broken_links(_links(c), c.site_paths)


@register("k11_missing_assets", views=("site_links", "site_paths"), oracle="""
SELECT page_id, asset, target FROM (SELECT DISTINCT page_id, href AS asset, split_part(split_part(href, '#', 1), '?', 1) AS target
  FROM site_links) t
WHERE target <> '' AND NOT (starts_with(target, 'http') OR starts_with(target, 'mailto:') OR starts_with(target, 'tel:') OR starts_with(target, '//'))
 AND target NOT IN (SELECT path FROM site_paths) AND target || '.html' NOT IN (SELECT path FROM site_paths)
 AND regexp_replace(target, '/$', '') || '/index.html' NOT IN (SELECT path FROM site_paths)""")
def k11(c):
    # the link list doubles as an asset list (src values resolve the same way)
    return K.missing_assets(_links(c).withColumnRenamed("href", "asset"), c.site_paths)


@register("k12_link_classes", views=("site_links",), oracle="""
SELECT page_id, count(*) FILTER (WHERE cls = 'internal') AS internal, count(*) FILTER (WHERE cls = 'external') AS external,
 count(*) FILTER (WHERE cls = 'mail_tel') AS mail_tel, count(*) FILTER (WHERE cls = 'anchor') AS anchor
FROM (SELECT page_id, CASE WHEN clean = '' THEN 'anchor' WHEN starts_with(clean, 'http') OR starts_with(clean, '//') THEN 'external'
   WHEN starts_with(clean, 'mailto:') OR starts_with(clean, 'tel:') THEN 'mail_tel' ELSE 'internal' END AS cls
  FROM (SELECT page_id, split_part(split_part(href, '#', 1), '?', 1) AS clean FROM site_links) a) b
GROUP BY page_id""")
def k12(c):
    return K.link_classes(c.site_links)


@register("k18_inbound_links", views=("site_links", "site_paths"), oracle=f"""
WITH {_TARGETS_SQL},
e AS (SELECT DISTINCT page_id AS src, dst_page_id FROM r WHERE dst_page_id IS NOT NULL AND dst_page_id <> page_id),
cnt AS (SELECT dst_page_id AS page_id, count(*) AS inbound FROM e GROUP BY 1)
SELECT p.page_id, p.path, coalesce(cnt.inbound, 0) AS inbound, coalesce(cnt.inbound, 0) = 0 AS orphan,
 coalesce(cnt.inbound, 0) < 2 AS under_min FROM site_paths p LEFT JOIN cnt USING (page_id)""")
def k18(c):
    return K.inbound_links(_links(c), c.site_paths, 2)


@register("k19_required_links", views=("site_links", "site_paths"), oracle=f"""
WITH {_TARGETS_SQL},
per AS (SELECT page_id, count(DISTINCT dst_page_id) AS internal_links,
   count(*) FILTER (WHERE dst_page_id = (SELECT page_id FROM site_paths WHERE path = '/p/0')) AS nreq
  FROM r WHERE dst_page_id IS NOT NULL GROUP BY page_id)
SELECT p.page_id, p.path, coalesce(per.nreq, 0) > 0 AS links_required, coalesce(per.internal_links, 0) AS internal_links
FROM site_paths p LEFT JOIN per USING (page_id)
WHERE NOT (coalesce(per.nreq, 0) > 0) OR coalesce(per.internal_links, 0) < 3""")
def k19(c):
    return K.required_links(_links(c), c.site_paths, "/p/0", 3)


@register("k23_unsafe_links", views=("site_links",), oracle=f"""
SELECT page_id, href FROM site_links WHERE NOT coalesce(regexp_matches(href, {sq(P.RE_SAFE_HREF)}), false)""")
def k23(c):
    return K.unsafe_links(c.site_links)


@register("k24_url_coverage", views=("site_links", "site_paths"), oracle="""
WITH e AS (SELECT DISTINCT regexp_replace(clean, '/$', '') AS u, true AS in_expected FROM (
   SELECT split_part(split_part(href, '#', 1), '?', 1) AS clean FROM site_links) a WHERE starts_with(clean, '/')),
s AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(path, '/index\\.html$', '/'), '\\.html$', ''), '/$', '') AS u,
   true AS in_site FROM site_paths)
SELECT coalesce(e.u, s.u) AS url, coalesce(in_expected, false) AS in_expected, coalesce(in_site, false) AS in_site
FROM e FULL OUTER JOIN s ON e.u = s.u WHERE NOT (coalesce(in_expected, false) AND coalesce(in_site, false))""")
def k24(c):
    clean = F.split(F.split(F.col("href"), "#", 2).getItem(0), r"\?", 2).getItem(0)
    expected = c.site_links.select(clean.alias("url")).filter(F.col("url").startswith("/"))
    return K.url_coverage(expected, c.site_paths)


# ---- K13-K17, K20-K22, K25-K28: page rules ---------------------------------------------

@register("k13_plan_values", oracle=f"""
SELECT page_id, {URL_PATH_SQL} AS path, len(list_distinct(regexp_extract_all(html, {sq(P.RE_CHECKOUT_PLAN)}, 1))) AS n_plans,
 len(list_filter(list_distinct(regexp_extract_all(html, {sq(P.RE_CHECKOUT_PLAN)}, 1)), lambda x: x NOT IN ('vpn', 'security_vpn'))) AS n_bad,
 len(list_distinct(regexp_extract_all(html, {sq(P.RE_CHECKOUT_PLAN)}, 1))) > 0 AND
 len(list_filter(list_distinct(regexp_extract_all(html, {sq(P.RE_CHECKOUT_PLAN)}, 1)), lambda x: x NOT IN ('vpn', 'security_vpn'))) = 0 AS ok
FROM pages""")
def k13(c):
    # every page of the test corpus is treated as a landing page
    return K.plan_values(c.pages, select=F.lit(True))


@register("k14_page_rules", oracle=f"""
SELECT page_id, path, 'no_download_links' AS rule FROM (SELECT page_id, {URL_PATH_SQL} AS path, html FROM pages) p
 WHERE contains(path, 'download') AND NOT contains(path, 'vpn-download') AND NOT regexp_matches(html, {sq(P.RE_DOWNLOAD_LINK)})
UNION ALL SELECT page_id, path, 'not_noindex' FROM (SELECT page_id, {URL_PATH_SQL} AS path, html FROM pages) p
 WHERE ends_with(path, '/404.html') AND NOT regexp_matches(html, {sq(P.RE_NOINDEX)})""")
def k14(c):
    return K.page_rules(c.pages)


_SELF_LANG = f"coalesce(nullif(regexp_extract(html, {sq(P.RE_HTML_LANG_VALUE)}, 1), ''), 'en')"


@register("k15_hreflang_gaps", oracle=f"""
SELECT page_id, {URL_PATH_SQL} AS path, {_SELF_LANG} AS self_lang,
 NOT len(list_filter(list_zip(regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 1), regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 2)),
   lambda x: x[1] = {_SELF_LANG} AND x[2] <> '')) > 0 AS missing_self,
 NOT len(list_filter(list_zip(regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 1), regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 2)),
   lambda x: x[1] = 'x-default' AND x[2] <> '')) > 0 AS missing_x_default
FROM pages""")
def k15(c):
    return K.hreflang_gaps(c.pages, index_only=False)


@register("k16_hreflang_returns", oracle=f"""
WITH pr AS (SELECT url AS src, unnest(regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 1)) AS lang,
   unnest(regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 2)) AS dst FROM pages),
p AS (SELECT * FROM pr WHERE dst <> src)
SELECT dst, src, lang FROM p WHERE dst IN (SELECT url FROM pages)
 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.src = p.dst AND b.dst = p.src)""")
def k16(c):
    return K.hreflang_returns(c.pages)


@register("k17_locale_rules", oracle=f"""
SELECT page_id, path, lang,
 (dir = CASE WHEN lang IN ('ar') THEN 'rtl' ELSE 'ltr' END) OR (dir = '' AND lang NOT IN ('ar')) AS dir_ok,
 og = '' OR starts_with(lower(og), lower(lang)) AS og_locale_ok,
 inl = '' OR starts_with(lower(inl), lower(lang)) AS in_language_ok,
 lang NOT IN ('ar') OR list_contains(regexp_extract_all(html, {sq(K.RE_LINK_TAG_HREF)}, 1), '/css/rtl.css') AS rtl_css_ok
FROM (SELECT page_id, html, {URL_PATH_SQL} AS path, regexp_extract(html, {sq(P.RE_HTML_LANG_VALUE)}, 1) AS lang,
  regexp_extract(html, {sq(P.RE_HTML_DIR_VALUE)}, 1) AS dir, {meta_sql('og:locale')} AS og,
  regexp_extract(html, {sq(K.JSONLD_INLANG)}, 1) AS inl FROM pages) t""")
def k17(c):
    return K.locale_rules(K.audit_pages(c.pages))


_TEXT = ("regexp_replace(regexp_replace(html, " + sq(r"(?is)<(script|style)[^>]*>.*?</(script|style)>") +
         ", ' ', 'g'), " + sq(r"<[^>]*>") + ", ' ', 'g')")
_PTYPE = "CASE WHEN contains(path, '/blog/') THEN 'blog' WHEN contains(path, '/compare/') THEN 'compare' ELSE 'page' END"


@register("k20_content_ranges", oracle=f"""
SELECT page_id, path, {_PTYPE} AS page_type, words, regexp_matches(html, {sq(P.RE_H1)}) AS has_h1,
 len(regexp_extract_all(html, {sq(r'(?i)(<h2[\s>])')}, 1)) AS n_h2,
 words >= CASE {_PTYPE} """ + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in RANGES.items()) + f""" END
 AND words <= CASE {_PTYPE} """ + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in RANGES.items()) + f""" END AS in_range
FROM (SELECT page_id, html, {URL_PATH_SQL} AS path, len(regexp_extract_all({_TEXT}, {sq('([^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f]+)')}, 1)) AS words FROM pages) t""")
def k20(c):
    return K.content_ranges(c.pages, RANGES)


@register("k21_faq_mismatch", oracle=f"""
SELECT page_id, path, len(v) AS n_visible, len(s) AS n_structured,
 len(list_filter(v, lambda x: NOT list_contains(s, x))) AS only_visible,
 len(list_filter(s, lambda x: NOT list_contains(v, x))) AS only_structured
FROM (SELECT page_id, {URL_PATH_SQL} AS path,
  list_distinct(list_transform(regexp_extract_all(html, {sq(K.FAQ_VISIBLE)}, 1), lambda x: {trim_sql('x')})) AS v,
  list_distinct(regexp_extract_all(html, {sq(K.FAQ_STRUCTURED)}, 1)) AS s FROM pages) t
WHERE len(v) > 0 OR len(s) > 0""")
def k21(c):
    return K.faq_mismatch(c.pages)


def _faq_paths(tail: str) -> str:
    """Strings at the places where a FAQ may lie in a JSON-LD block, as one list."""
    places = [f"{top}.mainEntity{items}" for top in ("$", "$[*]", '$."@graph"[*]', '$."@graph"[*]."@graph"[*]') for items in ("", "[*]")]
    lists = [f"""list_transform(coalesce(try_cast(json_extract(b, '{p}.{tail}') AS JSON[]), []), lambda x: x ->> '$')""" if "*" in p
             else f"""[x for x in [json_extract_string(b, '{p}.{tail}')] if x IS NOT NULL]""" for p in places]
    return "list_distinct(flatten([" + ", ".join(lists) + "]))"


@register("k21_faq_mismatch_json", views=("faq_pages",), oracle=f"""
WITH x AS (SELECT page_id, {URL_PATH_SQL} AS path,
  list_distinct(list_transform(regexp_extract_all(html, {sq(K.FAQ_VISIBLE)}, 1), lambda x: {trim_sql('x')})) AS v,
  list_distinct(list_transform(regexp_extract_all(html, {sq(K.FAQ_ANSWER_VISIBLE)}, 1), lambda x: {trim_sql('x')})) AS va,
  regexp_extract(html, '<script type="application/ld.json">(.*)</script>', 1) AS raw FROM faq_pages),
j AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS b FROM x),
s AS (SELECT *, {_faq_paths('name')} AS s, {_faq_paths('acceptedAnswer.text')} AS sa FROM j)
SELECT page_id, path, len(list_filter(v, lambda x: NOT list_contains(s, x))) AS only_visible,
 len(list_filter(s, lambda x: NOT list_contains(v, x))) AS only_structured,
 len(list_filter(va, lambda x: NOT list_contains(sa, x))) AS answers_only_visible,
 len(list_filter(sa, lambda x: NOT list_contains(va, x))) AS answers_only_structured
FROM s WHERE len(v) > 0 OR len(s) > 0""")
def k21_json(c):
    return K.faq_mismatch_strict(c.faq_pages)


@register("k22_corpus_consistency", oracle=f"""
WITH x AS (SELECT 'asset_version' AS kind, unnest(regexp_extract_all(html, {sq(P.RE_ASSET_VERSION)}, 1)) AS v FROM pages
 UNION ALL SELECT 'promo_end', unnest(regexp_extract_all(html, {sq('data-promo-end="([0-9]{4}-[0-9]{2}-[0-9]{2})"')}, 1)) FROM pages),
k AS (SELECT * FROM (VALUES ('asset_version'), ('promo_end')) t(kind))
SELECT k.kind, CAST(count(DISTINCT x.v) AS BIGINT) AS n_values, count(DISTINCT x.v) <= 1 AS consistent
FROM k LEFT JOIN x ON k.kind = x.kind GROUP BY k.kind""")
def k22(c):
    return K.corpus_consistency(c.pages)


_LANGS_SQL = ", ".join(f"('{x}')" for x in P.SUPPORTED_LANGS)


@register("k25_translation_gaps", oracle=f"""
SELECT k.source AS key, l.lang FROM (SELECT DISTINCT source FROM documents) k, (VALUES {_LANGS_SQL}) l(lang)
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source IS NOT DISTINCT FROM k.source AND d.lang = l.lang)""")
def k25(c):
    d = c.documents.select(F.col("source").alias("key"), "lang")
    return K.translation_gaps(d, P.SUPPORTED_LANGS)


@register("k26_key_usage_gaps", oracle=f"""
WITH used AS (SELECT DISTINCT unnest(regexp_extract_all(html, {sq(P.RE_I18N_KEY)}, 1)) AS key FROM pages),
base AS (SELECT DISTINCT source AS key FROM documents WHERE lang = 'en')
SELECT key, 'missing_in_locale' AS gap FROM used WHERE key NOT IN (SELECT key FROM base)
UNION ALL SELECT key, 'unused' FROM base WHERE key NOT IN (SELECT key FROM used)""")
def k26(c):
    keys = c.documents.filter(F.col("lang") == "en").select(F.col("source").alias("key"))
    return K.key_usage_gaps(c.pages, keys)


_LANG_PREFIX = "^/(" + "|".join(P.SUPPORTED_LANGS) + ")(/.*)$"


@register("k27_language_links", oracle=f"""
WITH pg AS (SELECT page_id, {URL_PATH_SQL} AS path, regexp_extract(html, {sq(P.RE_HTML_LANG_VALUE)}, 1) AS lang, html FROM pages),
tr AS (SELECT DISTINCT regexp_extract(path, {sq(_LANG_PREFIX)}, 2) AS base_path, regexp_extract(path, {sq(_LANG_PREFIX)}, 1) AS lang,
   path AS translated FROM pg WHERE regexp_matches(path, {sq(_LANG_PREFIX)})),
l AS (SELECT page_id, lang, split_part(split_part(href, '#', 1), '?', 1) AS base_path FROM (
   SELECT DISTINCT page_id, lang, unnest(regexp_extract_all(html, {sq(P.RE_HREF)}, 1)) AS href FROM pg) a)
SELECT l.base_path, l.lang, l.page_id, tr.translated FROM l JOIN tr ON l.base_path = tr.base_path AND l.lang = tr.lang
WHERE l.base_path <> tr.translated""")
def k27(c):
    a = K.audit_pages(c.pages)
    links = K.page_links(a).select("page_id", "href")
    langs = a.select("page_id", "lang")
    tr = a.filter(F.col("path").rlike(_LANG_PREFIX)).select(
        F.regexp_extract("path", _LANG_PREFIX, 2).alias("base_path"),
        F.regexp_extract("path", _LANG_PREFIX, 1).alias("lang"), "path").distinct()
    return K.language_links(links, langs, tr)


_FLAG_SQL = {
    "no_doctype": "NOT (lower(substr(html, 1, 15)) = '<!doctype html>')",
    "no_lang": f"NOT regexp_matches(html, {sq(P.RE_HTML_LANG)})",
    "no_charset": f"NOT regexp_matches(html, {sq(P.RE_CHARSET)})",
    "no_viewport": f"NOT regexp_matches(html, {sq(P.RE_VIEWPORT)})",
    "no_title": f"length({trim_sql(f'regexp_extract(html, {sq(P.RE_TITLE)}, 1)')}) = 0",
    "no_description": f"length({meta_sql('description')}) = 0",
    "no_canonical": f"NOT regexp_matches(html, {sq(P.RE_CANONICAL)})",
    "missing_social": "(" + " OR ".join(f"length({meta_sql(t)}) = 0" for t in K.SOCIAL_TAGS) + ")",
    "bad_jsonld": f"len(list_filter(regexp_extract_all(html, {sq(P.RE_JSONLD)}, 1), lambda b: NOT coalesce(json_valid({trim_sql('b')}), false))) > 0",
}


@register("k28_audit_scorecard", oracle="WITH f AS (SELECT regexp_extract(" + URL_PATH_SQL + ", '^/([^/]*)', 1) AS section, "
          f"regexp_extract(html, {sq(P.RE_HTML_LANG_VALUE)}, 1) AS lang, html FROM pages)\n" + "\nUNION ALL ".join(
              f"SELECT section, lang, '{k}' AS check, count(*) FILTER (WHERE {v}) AS failures, count(*) AS pages FROM f GROUP BY section, lang"
              for k, v in _FLAG_SQL.items()))
def k28(c):
    return K.audit_scorecard(K.structure_flags(K.audit_pages(c.pages)), ("section", "lang"))


@register("k16_hreflang_completeness", oracle=f"""
SELECT page_id, {URL_PATH_SQL} AS path, len(list_distinct(regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 1))) AS n_hreflang,
 len(list_filter({list(P.SUPPORTED_LANGS) + ['x-default']}, lambda x: NOT list_contains(
   list_distinct(regexp_extract_all(html, {sq(P.RE_HREFLANG)}, 1)), x))) AS n_missing
FROM pages""")
def k16c(c):
    # every page of the test corpus is treated as an index page
    return K.hreflang_completeness(c.pages, index_only=False)


@register("k19_section_links", views=("site_links", "site_paths"), oracle=f"""
WITH {_TARGETS_SQL},
pp AS (SELECT page_id, path, regexp_extract(path, '^/([^/]*)', 1) AS section FROM site_paths),
same AS (SELECT r.page_id, count(DISTINCT r.dst_page_id) AS same_section FROM r
  JOIN pp s ON s.page_id = r.page_id JOIN pp d ON d.page_id = r.dst_page_id
  WHERE r.dst_page_id IS NOT NULL AND r.dst_page_id <> r.page_id AND s.section = d.section GROUP BY r.page_id)
SELECT pp.page_id, pp.path, pp.section, coalesce(same.same_section, 0) AS same_section,
 CAST(CASE WHEN pp.section = 'p' THEN 3 END AS BIGINT) AS minimum
FROM pp LEFT JOIN same USING (page_id)
WHERE pp.section = 'p' AND coalesce(same.same_section, 0) < 3""")
def k19s(c):
    return K.section_links(_links(c), c.site_paths, {"p": 3})
