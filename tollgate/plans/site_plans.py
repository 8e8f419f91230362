"""The page audits once more, over the ``site_pages`` view, whose pages pass and fail
every check, with the page selections of K13, K15 and K16 on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.operators import siteaudit as K
from tollgate.plans import audit_plans as A
from tollgate.plans.registry import REGISTRY, register

AS_THEY_ARE = ("k1_k2_structure", "k3_title_description", "k4_canonical", "k5_social_tags", "k6_jsonld", "k7_jsonld_types",
               "k8_links", "k9_assets", "k14_page_rules", "k16_hreflang_returns", "k17_locale_rules", "k20_content_ranges",
               "k21_faq_mismatch", "k22_corpus_consistency", "k26_key_usage_gaps", "k27_language_links", "k28_audit_scorecard")


class _Site:
    """A catalog whose pages are the view's."""

    def __init__(self, catalog):
        self._catalog = catalog

    def __getattr__(self, name):
        return getattr(self._catalog, "site_pages" if name == "pages" else name)


def _on_site(sql: str) -> str:
    return sql.replace("FROM pages", "FROM site_pages")


def _again(name: str):
    plan = REGISTRY[name]
    register(f"{name}_site", views=(*plan.views, "site_pages"), oracle=_on_site(plan.oracle))(
        lambda c: plan.build(_Site(c)))


for _name in AS_THEY_ARE:
    _again(_name)

_INDEX = "ends_with(path, '/index.html') AND NOT contains(path, '/blog/')"


@register("k13_plan_values_site", views=("site_pages",), oracle=f"SELECT * FROM ({_on_site(REGISTRY['k13_plan_values'].oracle)}) t "
          "WHERE (contains(path, 'pricing') OR ends_with(path, '/index.html')) AND NOT contains(path, '/blog/')")
def k13(c):
    return K.plan_values(c.site_pages)


@register("k15_hreflang_gaps_site", views=("site_pages",), oracle=f"SELECT * FROM ({_on_site(REGISTRY['k15_hreflang_gaps'].oracle)}) t WHERE {_INDEX}")
def k15(c):
    return K.hreflang_gaps(c.site_pages)


@register("k16_hreflang_completeness_site", views=("site_pages",),
          oracle=f"SELECT * FROM ({_on_site(REGISTRY['k16_hreflang_completeness'].oracle)}) t WHERE {_INDEX}")
def k16(c):
    return K.hreflang_completeness(c.site_pages)


_BLOCKS = f"list_transform(regexp_extract_all(html, {A.sq(P.RE_JSONLD)}, 1), lambda b: {A.trim_sql('b')})"
_STRICT = f"""list_distinct(list_filter(flatten(list_transform(list_filter({_BLOCKS}, lambda b: json_valid(b)), lambda b:
  list_concat([json_extract_string(b, '$."@type"')], json_extract_string(b, '$."@graph"[*]."@type"')))), lambda t: t IS NOT NULL))"""


@register("k7_jsonld_types_strict", views=("site_pages",), oracle=f"""
SELECT page_id, len(types) AS n_types, len(list_filter({list(P.REQUIRED_JSONLD_TYPES)}, lambda t: NOT list_contains(types, t))) AS n_missing_types
FROM (SELECT page_id, {_STRICT} AS types FROM site_pages) t""")
def k7_strict(c):
    t = K.jsonld_types_strict(K.audit_pages(c.site_pages))
    return t.select("page_id", F.size("types").cast("long").alias("n_types"), F.size("missing_types").cast("long").alias("n_missing_types"))


@register("k11_missing_assets_site", views=("site_pages", "site_paths"), oracle=f"""
SELECT DISTINCT page_id, asset, target FROM (SELECT page_id, asset, split_part(split_part(asset, '#', 1), '?', 1) AS target FROM (
  SELECT page_id, unnest(list_concat(regexp_extract_all(html, {A.sq(P.RE_SRC)}, 1), list_filter(list_transform(
   flatten(list_transform(regexp_extract_all(html, {A.sq(P.RE_SRCSET)}, 1), lambda s: string_split(s, ','))),
   lambda p: regexp_split_to_array({A.trim_sql('p')}, {A.sq(A.WS + '+')})[1]), lambda u: u <> ''))) AS asset FROM site_pages) a) t
WHERE target <> '' AND NOT regexp_matches(target, '^(http|mailto:|tel:|//)') AND target NOT IN (SELECT path FROM site_paths)
 AND target || '.html' NOT IN (SELECT path FROM site_paths) AND regexp_replace(target, '/$', '') || '/index.html' NOT IN (SELECT path FROM site_paths)""")
def k11(c):
    a = K.audit_pages(c.site_pages).select("page_id", "path", F.explode("assets").alias("asset"))
    return K.missing_assets(a, c.site_paths).select("page_id", "asset", "target")


@register("k19_cross_section_links", views=("site_pages",), oracle=f"""
WITH p AS (SELECT page_id, html, {A.URL_PATH_SQL} AS path FROM site_pages),
l AS (SELECT page_id, split_part(split_part(unnest(regexp_extract_all(html, {A.sq(P.RE_HREF)}, 1)), '#', 1), '?', 1) AS target FROM p)
SELECT p.page_id, p.path, CAST((SELECT count(DISTINCT q.page_id) FROM l JOIN p q ON q.path = l.target
  WHERE l.page_id = p.page_id AND starts_with(q.path, '/compare/')) AS BIGINT) AS linked
FROM p WHERE starts_with(path, '/blog/') AND linked < 1""")
def k19_cross(c):
    a = K.audit_pages(c.site_pages)
    return K.cross_section_links(K.page_links(a), a.select("page_id", "path"), "blog", "compare")


@register("k20_heading_density", views=("site_pages",), oracle=f"""
SELECT *, CASE WHEN n_h2 > 0 THEN words / n_h2 END AS words_per_h2, n_h2 * 300 >= words AS dense_enough FROM (
 SELECT page_id, path, len(regexp_extract_all({A._TEXT}, {A.sq('([^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f]+)')}, 1)) AS words,
  len(regexp_extract_all(html, {A.sq(r'(?i)(<h2[\s>])')}, 1)) AS n_h2 FROM (SELECT page_id, html, {A.URL_PATH_SQL} AS path FROM site_pages) t) u""")
def k20_density(c):
    return K.heading_density(c.site_pages)


@register("k21_faq_answers", views=("site_pages",), oracle=f"""
SELECT page_id, path, len(list_filter(v, lambda x: NOT list_contains(s, x))) AS only_visible,
 len(list_filter(s, lambda x: NOT list_contains(v, x))) AS only_structured
FROM (SELECT page_id, {A.URL_PATH_SQL} AS path,
  list_distinct(list_transform(regexp_extract_all(html, {A.sq(K.FAQ_ANSWER_VISIBLE)}, 1), lambda x: {A.trim_sql('x')})) AS v,
  list_distinct(regexp_extract_all(html, {A.sq(K.FAQ_ANSWER_STRUCTURED)}, 1)) AS s FROM site_pages) t
WHERE len(v) > 0 OR len(s) > 0""")
def k21_answers(c):
    return K.faq_answer_mismatch(c.site_pages)
