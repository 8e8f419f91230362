"""Micro fixtures for the site audit (hand-written pages) and the sources/sinks."""
import json
import os

from pyspark.sql import functions as F

from tollgate.operators import siteaudit as K
from tollgate.sources import readers as R

OG = "".join(f'<meta property="{t}" content="x">' for t in K.P.REQUIRED_OG)
CARD = "".join(f'<meta name="{t}" content="x">' for t in K.P.REQUIRED_CARD)
LD_OK = ('<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Article", '
         '"inLanguage": "en", "mainEntity": {"@type": "FAQPage"}}</script>'
         '<script type="application/ld+json">{"@type": "BreadcrumbList", "items": [{"@type": "Question", '
         '"name": "What is it?"}, {"@type": "Question", "name": "Second?"}]}</script>')
HEAD = '<!DOCTYPE html><html lang="{lang}"{dir}><head><meta charset="UTF-8"><meta name="viewport" content="w">'

PAGES = {
    "/index.html": HEAD.format(lang="en", dir="") + '<title>\n  Home page \n</title>'
    '<meta name="description" content="About us">'
    '<link rel="canonical" href="/index.html">' + OG + CARD + LD_OK +
    '<link rel="alternate" hreflang="en" href="/index.html">'
    '<link rel="alternate" hreflang="fr" href="/fr/index.html">'
    '<link rel="alternate" hreflang="x-default" href="/index.html">'
    '</head><body><h1>Hi</h1><h2>a</h2><h2>b</h2>'
    '<button onclick="startCheckout(\'vpn\')">a</button><button onclick="startCheckout(\'security_vpn\')">b</button>'
    '<h3 class="faq-question"> What is it? </h3>'
    '<a href="/fr/index.html">fr</a><a href="about.html">about</a><a href="/downloads/app.zip">d</a>'
    '<a href="mailto:x@y.z">m</a><a href="#top">t</a></body></html>',
    "/fr/index.html": HEAD.format(lang="fr", dir="") + '<title>Accueil</title>'
    '<link rel="alternate" hreflang="fr" href="/fr/index.html"></head><body><a href="/fr/">x</a></body></html>',
    "/pricing.html": HEAD.format(lang="en", dir="") + '<title>Prices</title>'
    '<script type="application/ld+json">{"@type": "Product",}</script></head><body>'
    '<button onclick="startCheckout(\'gold\')">g</button>'
    '<img srcset="a.png 1x, b.png 2x"><img src="/img/missing.png"><script src="https://cdn.test/x.js"></script>'
    '</body></html>',
    "/404.html": HEAD.format(lang="en", dir="") + '<title>Not found</title></head><body></body></html>',
    "/download.html": HEAD.format(lang="en", dir="") + '<title>Get</title></head><body>'
    '<a href="/downloads/app.zip">zip</a></body></html>',
    "/ar/index.html": HEAD.format(lang="ar", dir=' dir="rtl"') + '<title>t</title>'
    '<meta property="og:locale" content="ar_AR"><link rel="stylesheet" href="/css/rtl.css"></head><body></body></html>',
    "/blog/post.html": HEAD.format(lang="en", dir=' dir="rtl"') + '<title>Post</title>'
    '<link rel="stylesheet" href="/css/site.css?v=2"></head><body><span data-i18n="nav.home">h</span>'
    '<span data-i18n="nav.unknown">u</span><script src="/js/app.js?v=3"></script>'
    '<p>one two  three\nfour</p><script>var words = "not counted";</script>'
    '<a href="../index.html">up</a><a href="javascript:alert(1)">bad</a></body></html>',
    "/tr/index.html": HEAD.format(lang="tr", dir="") + '<title>t</title></head><body>'
    '<a href="/pricing.html">p</a></body></html>',
    "/tr/pricing.html": HEAD.format(lang="tr", dir="") + '<title>t</title></head><body></body></html>',
}
EXTRA_FILES = ["/a.png", "/css/rtl.css", "/css/site.css", "/js/app.js"]


def _pages(spark):
    rows = [(i, p, h) for i, (p, h) in enumerate(sorted(PAGES.items()))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _paths(spark):
    rows = [(i, p) for i, p in enumerate(sorted(PAGES))] + [(100 + i, p) for i, p in enumerate(EXTRA_FILES)]
    return spark.createDataFrame(rows, "page_id long, path string")


def _by_path(df, col):
    return {r.path: r[col] for r in df.collect()}


def test_page_checks(spark):
    a = K.audit_pages(_pages(spark))
    home = a.filter("path = '/index.html'").first()
    assert home.has_doctype and home.has_lang and home.has_charset and home.has_viewport
    assert home.title == "Home page" and home.title_len == 9 and home.desc_len == 8
    assert home.canonical_self and home.missing_tags == [] and home.n_bad_jsonld == 0
    pricing = a.filter("path = '/pricing.html'").first()
    assert pricing.desc_len == 0 and len(pricing.missing_tags) == 10 and pricing.n_bad_jsonld == 1
    assert sorted(pricing.assets) == sorted(["a.png", "b.png", "/img/missing.png", "https://cdn.test/x.js"])
    types = {r.path: r.missing_types for r in K.jsonld_types(a).collect()}
    assert types["/index.html"] == [] and len(types["/404.html"]) == 3


def test_links_and_assets_resolve_against_known_paths(spark):
    a = K.audit_pages(_pages(spark))
    links = K.page_links(a)
    broken = {(r.page_id, r.href) for r in K.broken_links(links, _paths(spark)).collect()}
    ids = {p: i for i, p in enumerate(sorted(PAGES))}
    assert (ids["/index.html"], "about.html") in broken
    assert (ids["/blog/post.html"], "../index.html") not in broken        # resolved relative to /blog
    assert (ids["/fr/index.html"], "/fr/") not in broken                  # directory -> index.html
    assert all(h != "/downloads/app.zip" for _, h in broken)              # skipped prefix
    assets = a.select("page_id", "path", F.explode("assets").alias("asset"))
    missing = {r.asset for r in K.missing_assets(assets, _paths(spark)).collect()}
    assert missing == {"b.png", "/img/missing.png"}
    cls = {r.page_id: (r.internal, r.external, r.mail_tel, r.anchor) for r in K.link_classes(links).collect()}
    assert cls[ids["/index.html"]] == (3, 0, 1, 1)
    unsafe = {r.href for r in K.unsafe_links(links).collect()}
    assert unsafe == {"about.html", "mailto:x@y.z", "#top", "../index.html", "javascript:alert(1)"}


def test_page_rules_plans_hreflang(spark):
    p = _pages(spark)
    plans = {r.path: (r.n_plans, r.n_bad, r.ok) for r in K.plan_values(p).collect()}
    assert plans["/index.html"] == (2, 0, True) and plans["/pricing.html"] == (1, 1, False)
    assert "/blog/post.html" not in plans
    rules = {(r.path, r.rule) for r in K.page_rules(p).collect()}
    assert rules == {("/404.html", "not_noindex")}
    gaps = {r.path: (r.missing_self, r.missing_x_default) for r in K.hreflang_gaps(p).collect()}
    assert gaps["/index.html"] == (False, False) and gaps["/fr/index.html"] == (False, True)
    assert gaps["/ar/index.html"] == (True, True)
    ret = {(r.src, r.dst) for r in K.hreflang_returns(p).collect()}
    assert ret == {("/index.html", "/fr/index.html")}


def test_locale_faq_consistency_keys_language_links(spark):
    p = _pages(spark)
    a = K.audit_pages(p)
    loc = {r.path: (r.dir_ok, r.og_locale_ok, r.in_language_ok, r.rtl_css_ok) for r in K.locale_rules(a).collect()}
    assert loc["/ar/index.html"] == (True, True, True, True)
    assert loc["/blog/post.html"][0] is False
    faq = {r.path: (r.n_visible, r.n_structured, r.only_visible, r.only_structured)
           for r in K.faq_mismatch(p).collect()}
    assert faq == {"/index.html": (1, 2, 0, 1)}
    cons = {r.kind: (r.n_values, r.consistent) for r in K.corpus_consistency(p).collect()}
    assert cons == {"asset_version": (2, False), "promo_end": (0, True)}
    keys = spark.createDataFrame([("nav.home",), ("nav.pricing",)], "key string")
    gaps = {(r.key, r.gap) for r in K.key_usage_gaps(p, keys).collect()}
    assert gaps == {("nav.unknown", "missing_in_locale"), ("nav.pricing", "unused")}
    tr = spark.createDataFrame([("/pricing.html", "tr", "/tr/pricing.html")], "base_path string, lang string, path string")
    ll = K.language_links(K.page_links(a).select("page_id", "href"), a.select("page_id", "lang"), tr).collect()
    assert [(r.base_path, r.translated) for r in ll] == [("/pricing.html", "/tr/pricing.html")]
    words = {r.path: r.words for r in K.content_ranges(p, {"page": (1, 10)}).collect()}
    # title, two span texts, paragraph, two link texts; the script body is not text
    assert words["/blog/post.html"] == 1 + 2 + 4 + 2


def test_translation_gaps_and_coverage(spark):
    long = spark.createDataFrame([("a", "en"), ("a", "fr"), ("b", "en"), ("b", "xx")], "key string, lang string")
    gaps = {(r.key, r.lang) for r in K.translation_gaps(long, ("en", "fr", "es")).collect()}
    assert gaps == {("a", "es"), ("b", "fr"), ("b", "es")}
    exp = spark.createDataFrame([("/fr/",), ("/nowhere",)], "url string")
    cov = {r.url: (r.in_expected, r.in_site) for r in K.url_coverage(exp, _paths(spark)).collect()}
    assert cov["/nowhere"] == (True, False) and cov["/pricing"] == (False, True) and "/fr" not in cov


def test_load_pages_from_directory(spark, scratch):
    for p, h in PAGES.items():
        full = os.path.join(scratch, p.lstrip("/"))
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(h)
    with open(os.path.join(scratch, "notes.txt"), "w") as f:
        f.write("not a page")
    df = R.load_pages(spark, scratch)
    got = {r.path: len(r.html) for r in df.collect()}
    assert got == {p: len(h) for p, h in PAGES.items()}
    assert df.select("page_id").distinct().count() == len(PAGES)


def test_flatten_nested_locale(spark):
    doc = json.dumps({"nav": {"home": "Home", "pricing": "Prices"}, "title": "T"})
    df = spark.createDataFrame([("en", doc)], "lang string, json string")
    got = {(r.lang, r.key, r.value) for r in R.flatten_locales(df).collect()}
    assert got == {("en", "nav.home", "Home"), ("en", "nav.pricing", "Prices"), ("en", "title", "T")}


def test_access_log_parse(spark):
    lines = spark.createDataFrame([("[i0] [r1] POST /api/license 403 12ms ip=10.0.0.1",),
                                   ("garbage line",)], "value string")
    got = R.parse_access_log(lines).collect()
    assert (got[0].method, got[0].path, got[0].status, got[0].duration_ms) == ("POST", "/api/license", 403, 12)
    assert got[1].status is None and got[1].path is None


def test_billing_envelope_paths(spark):
    env = [
        {"id": "evt_1", "type": "checkout.session.completed", "created": 1700000000,
         "data": {"object": {"id": "cs_1", "customer": "cus_1", "subscription": "sub_1",
                             "customer_email": "b@x.io", "customer_details": {"email": "a@x.io"},
                             "metadata": {"plan": "vpn"}}}},
        {"id": "evt_2", "type": "invoice.payment_succeeded", "created": 1700000100,
         "data": {"object": {"id": "in_1", "subscription": "sub_1", "billing_reason": "subscription_cycle",
                             "lines": {"data": [{"period": {"end": 1731536000}}, {"period": {"end": 1}}]}}}},
        {"id": "evt_3", "type": "customer.subscription.updated", "created": 1700000200,
         "data": {"object": {"id": "sub_1", "cancel_at_period_end": True, "status": "active",
                             "customer_email": "c@x.io"}}},
    ]
    df = spark.createDataFrame([(json.dumps(e),) for e in env], "value string")
    got = {r.event_id: r for r in R.parse_billing_events(df).collect()}
    assert got["evt_1"].email == "a@x.io" and got["evt_1"].plan == "vpn" and got["evt_1"].kind == "checkout_completed"
    assert str(got["evt_2"].period_end) == "2024-11-13 22:13:20"
    assert got["evt_3"].subscription_id == "sub_1" and got["evt_3"].email == "c@x.io"


def test_audit_sink_partitions_by_date_and_schema_alignment(spark, scratch):
    d = spark.createDataFrame([("license_created", "license", 1, "plan=vpn", "2024-01-01 10:00:00"),
                               ("plan_changed", "subscription", 2, "new_plan=vpn", "2024-01-02 10:00:00")],
                              "action string, entity_type string, entity_id long, details string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    path = os.path.join(scratch, "audit")
    R.append_audit(R.audit_rows(d), path)
    R.append_audit(R.audit_rows(d), path)
    assert sorted(x for x in os.listdir(path) if x.startswith("date=")) == ["date=2024-01-01", "date=2024-01-02"]
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.filter("date = '2024-01-02'").count() == 2
    new = spark.createDataFrame([(1, "a", 5)], "id long, status string, node_id long")
    old = spark.createDataFrame([(2, "b")], "id long, status string")
    aligned = R.align_schema(old, new.schema).unionByName(new)
    assert {(r.id, r.node_id) for r in aligned.collect()} == {(1, 5), (2, None)}


def test_jsonld_types_strict_reads_only_top_level_and_graph(spark):
    a = K.audit_pages(_pages(spark))
    strict = {r.path: (sorted(r.types), r.missing_types) for r in K.jsonld_types_strict(a).collect()}
    # FAQPage sits under mainEntity: found by the lenient pattern form, not by the strict one
    assert strict["/index.html"] == (["Article", "BreadcrumbList"], ["FAQPage"])
    assert strict["/pricing.html"][0] == []                     # the block does not parse
    graph = spark.createDataFrame([(1, "/g.html", '<script type="application/ld+json">{"@graph": [{"@type": "FAQPage"}, '
                                   '{"@type": ["Article", "BreadcrumbList"]}]}</script>')], "page_id long, url string, html string")
    g = K.jsonld_types_strict(K.audit_pages(graph)).first()
    assert sorted(g.types) == ["Article", "BreadcrumbList", "FAQPage"] and g.missing_types == []


def test_flatten_json_keeps_arrays_whole_and_marks_malformed(spark):
    df = spark.createDataFrame([(1, '{"a":[1,2,3],"b":{"c":"x","d":null}}'), (2, "{bad"), (3, "[1,2]"), (4, None), (5, "{}")],
                               "id int, j string")
    got = sorted(((r.id, r.key, r.value, r.malformed) for r in R.flatten_json(df, ["id"], "j").collect()), key=repr)
    assert got == [(1, "a", "[1,2,3]", False), (1, "b.c", "x", False), (1, "b.d", None, False),
                   (2, None, None, True), (3, None, None, True), (4, None, None, True)]


def test_translation_gaps_count_empty_values_and_other_languages(spark):
    df = spark.createDataFrame([("k1", "en", "v"), ("k1", "ar", None), ("k2", "de", "w"), ("k3", "en", " "), ("k3", "ar", "x")],
                               "key string, lang string, value string")
    got = {(r.key, r.lang) for r in K.translation_gaps(df, ["en", "ar"]).collect()}
    assert got == {("k1", "ar"), ("k2", "en"), ("k2", "ar"), ("k3", "en")}
