"""Site audit over a page corpus.

``audit_pages`` computes every per-page check (K1-K9, K13-K15, K17, K20) in one
projection, so each page's text is scanned once and stays inside whole-stage
codegen; Catalyst drops the expressions a caller does not select.  Link and
asset checks explode (page, url) pairs with only the columns they need (the
page text is pruned before any shuffle) and resolve them with joins against the
set of known paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.functions.columns import (candidate_paths, is_external, literal_rows, page_dir, resolve_target,
                                        strip_hash_query, trim_ws, url_path, word_count)


def _extract_all(html: Column, pattern: str, idx: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), idx)


def _meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, P.meta_pattern(name), 1)


RE_META_PAIR = r'(?i)<meta\s+(?:name|property)="([^"]*)"\s+content="([^"]*)"'


def _meta_pairs(html: Column) -> Column:
    """Every (name, content) meta pair of a page, from one scan of the text."""
    return F.arrays_zip(_extract_all(html, RE_META_PAIR, 1).alias("n"),
                        _extract_all(html, RE_META_PAIR, 2).alias("c"))


def _meta_from(pairs: Column, name: str) -> Column:
    """Content of the first meta tag called ``name`` (case-insensitive), else ''."""
    hit = F.filter(pairs, lambda x: F.lower(x["n"]) == name.lower())
    return F.coalesce(F.try_element_at(hit, F.lit(1))["c"], F.lit(""))


def _srcset_urls(html: Column) -> Column:
    """First token of each comma-separated srcset entry, empty ones dropped."""
    sets = _extract_all(html, P.RE_SRCSET)
    parts = F.flatten(F.transform(sets, lambda s: F.split(s, ",")))
    firsts = F.transform(parts, lambda p: F.split(trim_ws(p), r"[ \t\n\r\f]+").getItem(0))
    return F.filter(firsts, lambda u: u != "")


SOCIAL_TAGS = P.REQUIRED_OG + P.REQUIRED_CARD
JSONLD_INLANG = r'"inLanguage"\s*:\s*"([^"]*)"'
FAQ_VISIBLE = r'(?i)<[a-z0-9]+[^>]*class="faq-question"[^>]*>([^<]*)<'
FAQ_STRUCTURED = r'"@type"\s*:\s*"Question"\s*,\s*"name"\s*:\s*"([^"]*)"'
FAQ_ANSWER_VISIBLE = r'(?i)<[a-z0-9]+[^>]*class="faq-answer"[^>]*>([^<]*)<'
FAQ_ANSWER_STRUCTURED = r'"@type"\s*:\s*"Answer"\s*,\s*"text"\s*:\s*"([^"]*)"'
JSONLD_TYPE = r'"@type"\s*:\s*"([^"]*)"'
RE_LINK_TAG_HREF = r'(?i)<link[^>]+href="([^"]*)"'


def audit_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """K1-K9 (+ parts of K15, K17, K20): one row per page with every check."""
    h = F.col(html_col)
    title = trim_ws(F.regexp_extract(h, P.RE_TITLE, 1))
    pairs = F.col("_meta")
    desc = _meta_from(pairs, "description")
    social = {t: _meta_from(pairs, t) for t in SOCIAL_TAGS}
    missing = F.filter(F.array(*[F.when(F.length(v) == 0, F.lit(t)) for t, v in social.items()]),
                       lambda x: x.isNotNull())
    jsonld = F.transform(_extract_all(h, P.RE_JSONLD), lambda b: trim_ws(b))
    links = _extract_all(h, P.RE_HREF)
    assets = F.concat(_extract_all(h, P.RE_SRC), _srcset_urls(h))
    canonical_href = F.regexp_extract(h, P.RE_CANONICAL_HREF, 1)
    lang = F.regexp_extract(h, P.RE_HTML_LANG_VALUE, 1)
    return pages.withColumn("_meta", _meta_pairs(h)).select(
        F.col("page_id"), F.col(url_col).alias("url"), url_path(url_col).alias("path"),
        (F.lower(F.substring(h, 1, len(P.RE_DOCTYPE_PREFIX))) == P.RE_DOCTYPE_PREFIX).alias("has_doctype"),
        h.rlike(P.RE_HTML_LANG).alias("has_lang"),
        lang.alias("lang"),
        F.regexp_extract(h, P.RE_HTML_DIR_VALUE, 1).alias("dir"),
        h.rlike(P.RE_CHARSET).alias("has_charset"),
        h.rlike(P.RE_VIEWPORT).alias("has_viewport"),
        title.alias("title"), F.length(title).cast("long").alias("title_len"),
        desc.alias("description"), F.length(desc).cast("long").alias("desc_len"),
        h.rlike(P.RE_CANONICAL).alias("has_canonical"),
        canonical_href.alias("canonical"),
        ((canonical_href != "") & (canonical_href == F.col(url_col))).alias("canonical_self"),
        missing.alias("missing_tags"),
        _meta_from(pairs, "og:locale").alias("og_locale"),
        jsonld.alias("jsonld"),
        F.size(F.filter(jsonld, lambda b: F.try_parse_json(b).isNull())).cast("long").alias("n_bad_jsonld"),
        F.regexp_extract(h, JSONLD_INLANG, 1).alias("in_language"),
        links.alias("links"), F.array_distinct(links).alias("distinct_links"),
        assets.alias("assets"),
        _extract_all(h, RE_LINK_TAG_HREF).alias("stylesheets"),
    )


def structure_flags(audit: DataFrame) -> DataFrame:
    """K1-K6 failures as booleans (True = check failed), for the scorecard."""
    return audit.select(
        "page_id", "path", "lang",
        (~F.col("has_doctype")).alias("no_doctype"), (~F.col("has_lang")).alias("no_lang"),
        (~F.col("has_charset")).alias("no_charset"), (~F.col("has_viewport")).alias("no_viewport"),
        (F.col("title_len") == 0).alias("no_title"), (F.col("desc_len") == 0).alias("no_description"),
        (~F.col("has_canonical")).alias("no_canonical"),
        (F.size("missing_tags") > 0).alias("missing_social"),
        (F.col("n_bad_jsonld") > 0).alias("bad_jsonld"))


# ---------------------------------------------------------------------------
# K7: JSON-LD types
# ---------------------------------------------------------------------------

def jsonld_types(audit: DataFrame, required=P.REQUIRED_JSONLD_TYPES) -> DataFrame:
    """K7: the @type values of each page's JSON-LD blocks (top level and nested,
    by pattern) and which required types are missing."""
    types = F.array_distinct(F.flatten(F.transform(F.col("jsonld"), lambda b: _extract_all(b, JSONLD_TYPE))))
    return audit.select("page_id", "path", types.alias("types")).select(
        "page_id", "path", "types",
        F.array_except(F.array(*[F.lit(t) for t in required]), F.col("types")).alias("missing_types"))


def _variant_types(v: Column) -> Column:
    """``@type`` of a parsed JSON object as an array (a string or an array of strings)."""
    arr = F.try_variant_get(v, "$['@type']", "array<string>")
    one = F.try_variant_get(v, "$['@type']", "string")
    return F.when(arr.isNotNull(), arr).when(one.isNotNull(), F.array(one)).otherwise(
        F.array().cast("array<string>"))


def jsonld_types_strict(audit: DataFrame, required=P.REQUIRED_JSONLD_TYPES) -> DataFrame:
    """K7 read as JSON (VARIANT): the types of each block's top-level object and
    of its ``@graph`` items only; a type mentioned deeper (e.g. under
    ``mainEntity``) does not count.  :func:`jsonld_types` is the lenient form."""
    def block_types(b):
        v = F.try_parse_json(b)
        graph = F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>"))
        return F.concat(_variant_types(v), F.flatten(F.transform(graph, _variant_types)))
    types = F.array_distinct(F.flatten(F.transform(F.col("jsonld"), block_types)))
    return audit.select("page_id", "path", types.alias("types")).select(
        "page_id", "path", "types",
        F.array_except(F.array(*[F.lit(t) for t in required]), F.col("types")).alias("missing_types"))


# ---------------------------------------------------------------------------
# links
# ---------------------------------------------------------------------------

def page_links(audit: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per (page, href); the page text is not carried along."""
    arr = "distinct_links" if distinct else "links"
    return audit.select("page_id", "path", F.explode(arr).alias("href"))


def link_class(href: Column) -> Column:
    """anchor / external / mail_tel / internal, from the href without its # and ? parts."""
    clean = strip_hash_query(href)
    return (F.when(clean == "", "anchor")
            .when(clean.startswith("http") | clean.startswith("//"), "external")
            .when(clean.startswith("mailto:") | clean.startswith("tel:"), "mail_tel")
            .otherwise("internal"))


def link_classes(links: DataFrame) -> DataFrame:
    """Link counts per page and class."""
    cls = link_class(F.col("href"))
    return links.groupBy("page_id").agg(
        *[F.count_if(cls == k).alias(k) for k in ("internal", "external", "mail_tel", "anchor")])


def _internal_targets(links: DataFrame, skip_prefixes=P.LINK_SKIP_PREFIXES,
                      base_col: str = "path") -> DataFrame:
    clean = strip_hash_query(F.col("href"))
    l = links.select("page_id", "href", base_col, clean.alias("_clean"))
    l = l.filter((F.col("_clean") != "") & ~is_external("_clean"))
    for p in skip_prefixes:
        l = l.filter(~F.col("_clean").startswith(p))
    return l.select("page_id", "href", resolve_target("_clean", page_dir(F.col(base_col))).alias("target"))


def resolve_links(links: DataFrame, paths: DataFrame, skip_prefixes=P.LINK_SKIP_PREFIXES) -> DataFrame:
    """Internal links with the page they resolve to (``dst_page_id`` NULL when
    none of the target, target + '.html', target + '/index.html' exists)."""
    t = _internal_targets(links, skip_prefixes)
    cand = t.select("page_id", "href", "target", F.posexplode(candidate_paths("target")).alias("_i", "_cand"))
    known = paths.select(F.col("path").alias("_cand"), F.col("page_id").alias("_dst"))
    # the left join keeps every candidate, so one aggregation per link yields
    # both hits (first matching candidate) and misses (NULL), and dedups links
    return (cand.join(known, "_cand", "left").groupBy("page_id", "href", "target")
            .agg(F.min_by("_dst", F.when(F.col("_dst").isNotNull(), F.col("_i"))).alias("dst_page_id")))


def broken_links(links: DataFrame, paths: DataFrame, skip_prefixes=P.LINK_SKIP_PREFIXES) -> DataFrame:
    """Internal links (per page, distinct) that resolve to no known file."""
    return resolve_links(links, paths, skip_prefixes).filter(F.col("dst_page_id").isNull()).drop("dst_page_id")


def missing_assets(assets: DataFrame, paths: DataFrame) -> DataFrame:
    """Local asset URLs (src, srcset) with no file; external ones skipped."""
    return broken_links(assets.withColumnRenamed("asset", "href"), paths, skip_prefixes=()) \
        .withColumnRenamed("href", "asset")


def inbound_links(links: DataFrame, paths: DataFrame, minimum: int = 2) -> DataFrame:
    """Distinct other pages linking to each page; orphans and pages under
    the minimum flagged."""
    r = (resolve_links(links, paths).filter(F.col("dst_page_id").isNotNull()
                                            & (F.col("dst_page_id") != F.col("page_id")))
         .select(F.col("page_id").alias("src"), F.col("dst_page_id").alias("page_id")).distinct())
    cnt = r.groupBy("page_id").agg(F.count(F.lit(1)).alias("inbound"))
    out = paths.select("page_id", "path").join(cnt, "page_id", "left").fillna(0, ["inbound"])
    return out.select("page_id", "path", F.col("inbound").cast("long").alias("inbound"),
                      (F.col("inbound") == 0).alias("orphan"), (F.col("inbound") < minimum).alias("under_min"))


def required_links(links: DataFrame, paths: DataFrame, required_path: str, min_internal: int = 3) -> DataFrame:
    """Pages that do not link to the required page, or have fewer internal
    links than ``min_internal`` (distinct resolved targets)."""
    req = paths.filter(F.col("path") == required_path).select(F.col("page_id").alias("_req"))
    r = resolve_links(links, paths).filter(F.col("dst_page_id").isNotNull())
    per = (r.join(req.distinct(), F.col("dst_page_id") == F.col("_req"), "left")
           .groupBy("page_id").agg(F.count_distinct("dst_page_id").alias("internal_links"),
                                   F.count("_req").alias("_nreq")))
    out = paths.select("page_id", "path").join(per, "page_id", "left").fillna(0, ["internal_links", "_nreq"])
    out = out.select("page_id", "path", (F.col("_nreq") > 0).alias("links_required"),
                     F.col("internal_links").cast("long").alias("internal_links"))
    return out.filter(~F.col("links_required") | (F.col("internal_links") < min_internal))


def section_links(links: DataFrame, paths: DataFrame, minimums: dict[str, int]) -> DataFrame:
    """K19 (cross-link minimums): pages of a section (first path segment) that
    link to fewer distinct other pages of the same section than its minimum."""
    sec = F.regexp_extract(F.col("path"), r"^/([^/]*)", 1)
    pp = paths.select("page_id", "path", sec.alias("section"))
    r = resolve_links(links, paths).filter(F.col("dst_page_id").isNotNull()
                                           & (F.col("dst_page_id") != F.col("page_id")))
    dst = pp.select(F.col("page_id").alias("dst_page_id"), F.col("section").alias("dst_section"))
    same = (r.join(pp.select("page_id", "section"), "page_id").join(dst, "dst_page_id")
            .filter(F.col("section") == F.col("dst_section"))
            .groupBy("page_id").agg(F.count_distinct("dst_page_id").alias("same_section")))
    mins = F.coalesce(*[F.when(F.col("section") == k, F.lit(v)) for k, v in minimums.items()], F.lit(None))
    out = pp.join(same, "page_id", "left").select(
        "page_id", "path", "section", F.coalesce("same_section", F.lit(0)).cast("long").alias("same_section"),
        mins.cast("long").alias("minimum"))
    return out.filter(F.col("minimum").isNotNull() & (F.col("same_section") < F.col("minimum")))


def cross_section_links(links: DataFrame, paths: DataFrame, source: str, target: str, minimum: int = 1) -> DataFrame:
    """K19 (cross-section minimum): pages of section ``source`` that link to fewer than
    ``minimum`` distinct pages of section ``target`` (sections are first path segments)."""
    sec = F.regexp_extract(F.col("path"), r"^/([^/]*)/", 1)
    pp = paths.select("page_id", "path", sec.alias("section"))
    r = resolve_links(links, paths).filter(F.col("dst_page_id").isNotNull())
    there = pp.filter(F.col("section") == target).select(F.col("page_id").alias("dst_page_id"))
    per = r.join(there, "dst_page_id", "left_semi").groupBy("page_id").agg(F.count_distinct("dst_page_id").alias("n"))
    out = pp.filter(F.col("section") == source).join(per, "page_id", "left")
    return out.select("page_id", "path", F.coalesce("n", F.lit(0)).cast("long").alias("linked")).filter(F.col("linked") < minimum)


def unsafe_links(links: DataFrame) -> DataFrame:
    """Hrefs that are neither http(s) URLs nor root-relative."""
    return links.filter(~F.coalesce(F.col("href").rlike(P.RE_SAFE_HREF), F.lit(False)))


# ---------------------------------------------------------------------------
# Page rules
# ---------------------------------------------------------------------------

def plan_values(pages: DataFrame, allowed=P.CHECKOUT_PLANS, select: Column | None = None,
                pattern: str = P.RE_CHECKOUT_PLAN) -> DataFrame:
    """Checkout plan values on pricing/landing pages (path contains 'pricing'
    or ends with '/index.html', not under '/blog/'): at least one, all allowed."""
    p = pages.select("page_id", url_path("url").alias("path"), "html")
    sel = select if select is not None else (
        (F.col("path").contains("pricing") | F.col("path").endswith("/index.html"))
        & ~F.col("path").contains("/blog/"))
    plans = F.array_distinct(_extract_all(F.col("html"), pattern))
    bad = F.array_except(plans, F.array(*[F.lit(a) for a in allowed]))
    return p.filter(sel).select("page_id", "path", F.size(plans).cast("long").alias("n_plans"),
                                F.size(bad).cast("long").alias("n_bad"),
                                ((F.size(plans) > 0) & (F.size(bad) == 0)).alias("ok"))


def page_rules(pages: DataFrame, skip: str = P.DOWNLOAD_PAGE_SKIP) -> DataFrame:
    """Download pages (but paths that contain ``skip``) must carry download links;
    the not-found page must be noindex.  One row per violation."""
    p = pages.select("page_id", url_path("url").alias("path"), "html")
    path, h = F.col("path"), F.col("html")
    dl = p.filter(path.contains("download") & ~path.contains(skip) & ~h.rlike(P.RE_DOWNLOAD_LINK))
    nf = p.filter(path.endswith("/404.html") & ~h.rlike(P.RE_NOINDEX))
    return (dl.select("page_id", "path", F.lit("no_download_links").alias("rule"))
            .unionByName(nf.select("page_id", "path", F.lit("not_noindex").alias("rule"))))


def _hreflang_pairs(html: Column) -> Column:
    return F.arrays_zip(_extract_all(html, P.RE_HREFLANG, 1).alias("lang"),
                        _extract_all(html, P.RE_HREFLANG, 2).alias("href"))


def hreflang_gaps(pages: DataFrame, index_only: bool = True) -> DataFrame:
    """Index pages must name their own language (html lang, default 'en')
    and x-default in their hreflang links."""
    p = pages.select("page_id", url_path("url").alias("path"), "html")
    if index_only:
        p = p.filter(F.col("path").endswith("/index.html") & ~F.col("path").contains("/blog/"))
    lang = F.regexp_extract("html", P.RE_HTML_LANG_VALUE, 1)
    self_lang = F.when(lang == "", "en").otherwise(lang)
    pairs = _hreflang_pairs(F.col("html"))

    def has(lg):
        return F.exists(pairs, lambda x: (x["lang"] == lg) & (x["href"] != ""))
    return p.select("page_id", "path", self_lang.alias("self_lang"),
                    (~has(self_lang)).alias("missing_self"), (~has(F.lit("x-default"))).alias("missing_x_default"))


def hreflang_completeness(pages: DataFrame, languages=P.SUPPORTED_LANGS, index_only: bool = True) -> DataFrame:
    """K16 (completeness): index pages must carry an hreflang link for every
    supported language and x-default (eight tags for seven languages)."""
    p = pages.select("page_id", url_path("url").alias("path"), "html")
    if index_only:
        p = p.filter(F.col("path").endswith("/index.html") & ~F.col("path").contains("/blog/"))
    want = F.array(*[F.lit(x) for x in list(languages) + ["x-default"]])
    have = F.array_distinct(_extract_all(F.col("html"), P.RE_HREFLANG, 1))
    return p.select("page_id", "path", F.size(have).cast("long").alias("n_hreflang"),
                    F.size(F.array_except(want, have)).cast("long").alias("n_missing"))


def hreflang_returns(pages: DataFrame) -> DataFrame:
    """Hreflang links A -> B between pages of the corpus where B does not
    link back to A."""
    pairs = pages.select(F.col("url").alias("src"), F.inline(_hreflang_pairs(F.col("html")))) \
        .select("src", "lang", F.col("href").alias("dst")).filter(F.col("dst") != F.col("src"))
    urls = pages.select(F.col("url").alias("dst"))
    inside = pairs.join(urls, "dst", "left_semi")
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return inside.join(back, ["src", "dst"], "left_anti")


def locale_rules(audit: DataFrame, rtl_langs=P.RTL_LANGS, rtl_css=P.RTL_STYLESHEET) -> DataFrame:
    """Direction matches the language, og:locale and JSON-LD inLanguage agree
    with it, RTL pages load the RTL stylesheet.  Missing values do not fail."""
    lang = F.col("lang")
    rtl = lang.isin(*rtl_langs)
    expected_dir = F.when(rtl, "rtl").otherwise("ltr")
    dir_ok = (F.col("dir") == expected_dir) | ((F.col("dir") == "") & ~rtl)
    og = F.col("og_locale")
    og_ok = (og == "") | F.lower(og).startswith(F.lower(lang))
    inl = F.col("in_language")
    inl_ok = (inl == "") | F.lower(inl).startswith(F.lower(lang))
    css_ok = ~rtl | F.array_contains(F.col("stylesheets"), rtl_css)
    return audit.select("page_id", "path", "lang", dir_ok.alias("dir_ok"), og_ok.alias("og_locale_ok"),
                        inl_ok.alias("in_language_ok"), css_ok.alias("rtl_css_ok"))


def content_ranges(pages: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Visible word count (scripts, styles and tags removed), H1 present, H2
    count, and whether the word count is inside the range of the page type
    ('blog', 'compare' or 'page', from the path)."""
    p = pages.select("page_id", url_path("url").alias("path"), "html")
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    ptype = (F.when(F.col("path").contains("/blog/"), "blog")
             .when(F.col("path").contains("/compare/"), "compare").otherwise("page"))
    words = word_count(text)
    lo = F.coalesce(*[F.when(ptype == k, F.lit(v[0])) for k, v in ranges.items()], F.lit(0))
    hi = F.coalesce(*[F.when(ptype == k, F.lit(v[1])) for k, v in ranges.items()], F.lit(None).cast("int"))
    return p.select("page_id", "path", ptype.alias("page_type"), words.cast("long").alias("words"),
                    F.col("html").rlike(P.RE_H1).alias("has_h1"),
                    F.size(_extract_all(F.col("html"), r"(?i)(<h2[\s>])", 1)).cast("long").alias("n_h2"),
                    ((words >= lo) & (hi.isNull() | (words <= hi))).alias("in_range"))


def faq_mismatch(pages: DataFrame) -> DataFrame:
    """FAQ questions shown on the page vs those in the FAQ structured data."""
    vis = F.array_distinct(F.transform(_extract_all(F.col("html"), FAQ_VISIBLE), lambda s: trim_ws(s)))
    st = F.array_distinct(_extract_all(F.col("html"), FAQ_STRUCTURED))
    p = pages.select("page_id", url_path("url").alias("path"), vis.alias("v"), st.alias("s"))
    return p.filter((F.size("v") > 0) | (F.size("s") > 0)).select(
        "page_id", "path", F.size("v").cast("long").alias("n_visible"),
        F.size("s").cast("long").alias("n_structured"),
        F.size(F.array_except("v", "s")).cast("long").alias("only_visible"),
        F.size(F.array_except("s", "v")).cast("long").alias("only_structured"))


def faq_answer_mismatch(pages: DataFrame) -> DataFrame:
    """K21 (answers): FAQ answer texts shown on the page vs those in the structured data."""
    vis = F.array_distinct(F.transform(_extract_all(F.col("html"), FAQ_ANSWER_VISIBLE), lambda s: trim_ws(s)))
    st = F.array_distinct(_extract_all(F.col("html"), FAQ_ANSWER_STRUCTURED))
    p = pages.select("page_id", url_path("url").alias("path"), vis.alias("v"), st.alias("s"))
    return p.filter((F.size("v") > 0) | (F.size("s") > 0)).select(
        "page_id", "path", F.size(F.array_except("v", "s")).cast("long").alias("only_visible"),
        F.size(F.array_except("s", "v")).cast("long").alias("only_structured"))


def _list_at(v: Column, path: str) -> Column:
    """What lies at a path, as an array: its items, or the one object that it is."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def _flat(values: Column, inner) -> Column:
    return F.flatten(F.transform(values, inner))


def faq_structured(jsonld: Column) -> Column:
    """The questions of a page's JSON-LD blocks as structs (name, text), read as JSON: ``Question``
    objects in the ``mainEntity`` (a list or one object) of the ``FAQPage`` objects at the top, in a
    top-level list, and in ``@graph`` lists two deep.  Strings are decoded."""
    tops = _flat(jsonld, lambda b: _list_at(F.try_parse_json(b), "$"))
    once = _flat(tops, lambda v: F.concat(F.array(v), _list_at(v, "$['@graph']")))
    nodes = _flat(once, lambda v: F.concat(F.array(v), F.when(F.try_variant_get(v, "$['@type']", "string").isNull(), _list_at(v, "$['@graph']"))
                                           .otherwise(F.array().cast("array<variant>"))))
    pages = F.filter(nodes, lambda v: F.array_contains(_variant_types(v), "FAQPage"))
    asked = F.filter(_flat(pages, lambda v: _list_at(v, "$.mainEntity")), lambda v: F.array_contains(_variant_types(v), "Question"))
    return F.array_distinct(F.transform(asked, lambda v: F.struct(
        trim_ws(F.try_variant_get(v, "$.name", "string")).alias("name"),
        trim_ws(F.coalesce(F.try_variant_get(v, "$.acceptedAnswer.text", "string"), F.try_variant_get(v, "$.acceptedAnswer[0].text", "string"))).alias("text"))))


def faq_mismatch_strict(pages: DataFrame) -> DataFrame:
    """K21 read as JSON (:func:`faq_structured`): questions and answers shown on a page against those
    of its structured data, both ways.  :func:`faq_mismatch` is the lenient form by pattern."""
    def shown(pattern):
        return F.array_distinct(F.transform(_extract_all(F.col("html"), pattern), lambda s: trim_ws(s)))
    blocks = F.transform(_extract_all(F.col("html"), P.RE_JSONLD), lambda b: trim_ws(b))
    p = pages.select("page_id", url_path("url").alias("path"), shown(FAQ_VISIBLE).alias("v"), shown(FAQ_ANSWER_VISIBLE).alias("va"),
                     faq_structured(blocks).alias("q"))
    p = p.withColumns({"s": F.array_distinct(F.col("q.name")), "sa": F.array_distinct(F.filter(F.col("q.text"), lambda x: x.isNotNull()))})
    n = lambda a, b: F.size(F.array_except(a, b)).cast("long")
    return p.filter((F.size("v") > 0) | (F.size("s") > 0)).select(
        "page_id", "path", n("v", "s").alias("only_visible"), n("s", "v").alias("only_structured"),
        n("va", "sa").alias("answers_only_visible"), n("sa", "va").alias("answers_only_structured"))


def heading_density(pages: DataFrame, words_per_h2: int = 300) -> DataFrame:
    """K20 (headings): visible words per H2, and whether a page has at least one H2 for
    every ``words_per_h2`` words."""
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    words = word_count(F.regexp_replace(text, r"<[^>]*>", " "))
    h2 = F.size(_extract_all(F.col("html"), r"(?i)(<h2[\s>])", 1))
    p = pages.select("page_id", url_path("url").alias("path"), words.cast("long").alias("words"), h2.cast("long").alias("n_h2"))
    return p.select("*", F.try_divide("words", "n_h2").alias("words_per_h2"),
                    (F.col("n_h2") * words_per_h2 >= F.col("words")).alias("dense_enough"))


def corpus_consistency(pages: DataFrame, version_re=P.RE_ASSET_VERSION,
                       promo_re=r"data-promo-end=\"([0-9]{4}-[0-9]{2}-[0-9]{2})\"") -> DataFrame:
    """Distinct asset versions and promo end dates over the whole corpus
    (one row); consistent when each has at most one value."""
    v = pages.select(F.explode(_extract_all(F.col("html"), version_re)).alias("x")).select(
        F.lit("asset_version").alias("kind"), "x")
    d = pages.select(F.explode(_extract_all(F.col("html"), promo_re)).alias("x")).select(
        F.lit("promo_end").alias("kind"), "x")
    g = v.unionByName(d).groupBy("kind").agg(F.count_distinct("x").alias("n_values"))
    kinds = literal_rows(pages.sparkSession, [("asset_version",), ("promo_end",)], "kind string")
    return kinds.join(g, "kind", "left").fillna(0, ["n_values"]).select(
        "kind", F.col("n_values").cast("long").alias("n_values"), (F.col("n_values") <= 1).alias("consistent"))


# ---------------------------------------------------------------------------
# Coverage, translations, scorecard
# ---------------------------------------------------------------------------

def served_url(path: Column) -> Column:
    """URL a file is served at: '/a/index.html' -> '/a/', '/a.html' -> '/a'."""
    return F.regexp_replace(F.regexp_replace(path, r"/index\.html$", "/"), r"\.html$", "")


def url_coverage(expected: DataFrame, paths: DataFrame) -> DataFrame:
    """Expected URLs (sitemap / precache list) with no page, and pages no
    list names; URLs compared without a trailing slash."""
    e = expected.select(F.regexp_replace("url", "/$", "").alias("u"), F.lit(True).alias("in_expected")).distinct()
    s = paths.select(F.regexp_replace(served_url(F.col("path")), "/$", "").alias("u"),
                     F.lit(True).alias("in_site")).distinct()
    j = e.join(s, "u", "full_outer")
    return j.select(F.col("u").alias("url"), F.coalesce("in_expected", F.lit(False)).alias("in_expected"),
                    F.coalesce("in_site", F.lit(False)).alias("in_site")).filter(
        ~(F.col("in_expected") & F.col("in_site")))


def translation_gaps(long: DataFrame, languages, key_col="key", lang_col="lang", value_col="value") -> DataFrame:
    """(key, language) pairs with no value.  Every key of any language counts;
    NULL and empty values are no translation.  Per key the set of present languages
    is bounded by the language list, so no key x language cross product is formed."""
    langs = F.array(*[F.lit(x) for x in languages])
    there = F.col(lang_col).isin(*languages)
    if value_col in long.columns:
        there = there & (F.trim(F.coalesce(F.col(value_col).cast("string"), F.lit(""))) != "")
    present = long.groupBy(key_col).agg(F.collect_set(F.when(there, F.col(lang_col))).alias("_have"))
    return present.select(key_col, F.explode(F.array_except(langs, F.col("_have"))).alias(lang_col))


def key_usage_gaps(pages: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Translation keys used in pages but absent from the base locale, and
    base-locale keys no page uses."""
    used = pages.select(F.explode(_extract_all(F.col("html"), P.RE_I18N_KEY)).alias("key")).distinct()
    base = keys.select(F.col(key_col).alias("key")).distinct()
    return (used.join(base, "key", "left_anti").select("key", F.lit("missing_in_locale").alias("gap"))
            .unionByName(base.join(used, "key", "left_anti").select("key", F.lit("unused").alias("gap"))))


def language_links(links: DataFrame, page_langs: DataFrame, translations: DataFrame) -> DataFrame:
    """Links from a page in language L to a base page that has an L
    translation (link to the translation instead).  ``translations`` holds
    (base_path, lang, path)."""
    l = links.join(page_langs, "page_id").select("page_id", "lang", strip_hash_query(F.col("href")).alias("base_path"))
    t = translations.select("base_path", "lang", F.col("path").alias("translated"))
    return l.join(t, ["base_path", "lang"]).filter(F.col("base_path") != F.col("translated"))


def audit_scorecard(flags: DataFrame, by=("section", "lang")) -> DataFrame:
    """Failures per check and group; flags are boolean failure columns."""
    checks = [c for c in flags.columns if c not in ("page_id", "path", "lang", "section")]
    f = flags
    if "section" in by and "section" not in flags.columns:
        f = f.withColumn("section", F.regexp_extract("path", r"^/([^/]*)", 1))
    # one count per check and group, then one row per check of the few groups
    per = f.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(c).alias(f"_{c}") for c in checks])
    return per.select(*by, "pages", F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"_{c}").alias("failures"))
                                                       for c in checks]))).select(*by, "check", "failures", "pages")
