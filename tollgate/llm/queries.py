"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tollgate.llm import (chat_format, exact_dedup, fill_middle, importance, minhash_dedup, mixing, packing, pq_dedup, quality_classifier,
                          quality_rules, secret_scan, suffix_dedup, url_filter)
from tollgate.llm.common import table

#: The rules of the url query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1(spark, sf_dir):
    return exact_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op4(spark, sf_dir):
    return packing.report(packing.pack(table(spark, sf_dir, "documents")))


def op5(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"),
                                quality_rules.trusted_documents(table(spark, sf_dir, "labels")))


def op7(spark, sf_dir):
    return suffix_dedup.report(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op8(spark, sf_dir):
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op10(spark, sf_dir):
    return minhash_dedup.groups(table(spark, sf_dir, "documents"), k=2)


def op11(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark, sf_dir):
    return pq_dedup.groups(table(spark, sf_dir, "embeddings"))


def op13(spark, sf_dir):
    return fill_middle.report(fill_middle.transform(table(spark, sf_dir, "documents")))


QUERIES = {"op10_minhash_dedup": op10, "op1_exact_dedup": op1, "op2_chat_format": op2, "op3_quality_classifier": op3, "op4_packing": op4, "op5_mixing": op5, "op6_quality_rules": op6, "op7_suffix_dedup": op7, "op8_secret_scan": op8, "op9_url_filter": op9,
           "op11_importance_resampling": op11, "op12_embedding_dedup": op12, "op13_fill_middle": op13}

ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t)
                 AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "op9_url_filter": """
        WITH rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
               ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        cut AS (SELECT row_number() OVER () AS n, page_id,
                  CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        fits AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
                   arg_max(r_verdict, length(r_host || r_path)) AS verdict
                 FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
                 GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)""",
    "op13_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
                ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
        c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t
                      WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                      ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM c""",
}
