"""SURVEY section 2 ID -> functions -> registered queries (renders docs/COVERAGE.md)."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# ID: (functions, registered queries, note)
COVERAGE = {
    "A1": ("sources.tables.load_table, table_counts", ["a1_table_counts"], ""),
    "A2": ("sources.readers.load_pages", ["a2_pages_corpus"], "directory reader tested on a page tree"),
    "A3": ("sources.readers.flatten_json, flatten_locales", ["a3_flatten_json"], "nested locale test"),
    "A4": ("sources.readers.parse_access_log, render_access_log", ["a4_access_log"], ""),
    "A5": ("sources.readers.parse_billing_events, render_billing_events", ["a5_billing_envelopes"], ""),
    "A6": ("entitlements.billing_outcomes, sources.readers.audit_rows, append_audit, read_audit", ["a6_audit_actions", "a6_audit_all", "a6_audit_sink"], "idempotent sink test"),
    "A7": ("operators.metrics.metric_snapshot", ["a7_metric_snapshot"], ""),
    "A8": ("sources.readers.align_schema, read_versions", ["a8_align_schema", "a8_two_versions"], ""),
    "B1": ("entitlements.format_violations", ["b1_format_violations"], ""),
    "B2": ("entitlements.mask_pii (+ columns.mask_key/mask_email/redact_email/mask_url_secret)", ["b2_mask_pii"], ""),
    "B3": ("columns.classify_platform", ["b3_platform"], ""),
    "B4": ("entitlements.validation_outcome", ["b4_validation"], ""),
    "B5": ("entitlements.vpn_access_outcome", ["b5_vpn_access"], ""),
    "B6": ("entitlements.key_delete_outcome", ["b6_key_delete"], ""),
    "B7": ("entitlements.transfer_decision", ["b7_transfer"], "72 h boundary fixture"),
    "B8": ("entitlements.price_dimension, price_as_of, price_as_of_history (ranking.last_before)", ["b8_price_as_of", "b8_price_history", "b8_price_history_by_count"], ""),
    "B9": ("entitlements.expired_with_keys", ["b9_expired_with_keys"], ""),
    "B10": ("entitlements.stale_claims", ["b10_stale_claims"], ""),
    "B11": ("entitlements.reset_stale", ["b11_reset_stale"], ""),
    "B12": ("entitlements.prune", ["b12_prune_events"], ""),
    "B13": ("entitlements.due_retries", ["b13_due_retries"], ""),
    "B14": ("columns.normalize_route", ["d10_request_counter"], ""),
    "B15": ("capacity.active_nodes", ["b15_active_nodes"], ""),
    "C1": ("entitlements.lookup_license", ["c1_lookup_license"], ""),
    "C2": ("capacity.orphan_keys", ["c2_orphan_keys", "c2_orphan_keys_by_node"], ""),
    "C3": ("capacity.missing_keys", ["c3_missing_keys"], ""),
    "C4": ("capacity.resolve_node", ["c4_resolve_node", "c4_resolve_node_any_status"], ""),
    "C5": ("entitlements.resolve_refunds", ["c5_resolve_refunds"], ""),
    "C6": ("entitlements.late_inactive", ["c6_late_inactive"], ""),
    "C7": ("entitlements.new_checkouts", ["c7_new_checkouts"], ""),
    "D1": ("entitlements.active_licenses / licence_gauges", ["d1_active_licenses"], ""),
    "D2": ("entitlements.active_keys / licence_gauges", ["d2_active_keys"], ""),
    "D3": ("entitlements.stale_claim_count / licence_gauges", ["d3_stale_claim_count"], ""),
    "D4": ("entitlements.retry_depth", ["d4_retry_depth"], ""),
    "D5": ("capacity.key_drift", ["d5_key_drift"], "entry() flagship"),
    "D6": ("capacity.node_key_count / node_load", ["d6_node_key_count"], ""),
    "D7": ("capacity.least_loaded", ["d7_least_loaded"], ""),
    "D8": ("capacity.reconcile_summary (ROLLUP)", ["d8_reconcile_summary"], ""),
    "D9": ("metrics.device_counts", ["d9_device_counts"], ""),
    "D10": ("metrics.counter", ["d10_request_counter", "d10_log_line_counter"], "log lines -> parse -> counter"),
    "D11": ("metrics.counter over validation_outcome", ["d11_validation_counter"], ""),
    "D12": ("metrics.counter", ["d12_provisioned_by_plan"], ""),
    "D13": ("metrics.counter over entitlements.billing_outcomes", ["d13_billing_counter"], ""),
    "D14": ("metrics.counter", ["d14_checkout_counter"], ""),
    "D15": ("metrics.counter", ["d15_upstream_counter"], ""),
    "D16": ("metrics.counter", ["d16_email_counter"], ""),
    "D17": ("metrics.histogram", ["d17_request_histogram"], "edge fixtures, property test"),
    "D18": ("metrics.histogram", ["d18_upstream_histogram"], ""),
    "D19": ("metrics.histogram_quantile", ["d19_histogram_quantiles"], "PromQL cases fixture"),
    "D20": ("metrics.sum_by", ["d20_sum_by_status"], ""),
    "D21": ("capacity.health_rollup", ["d21_health_rollup"], ""),
    "E1": ("entitlements.latest_per", ["e1_latest_per_customer"], ""),
    "E2": ("entitlements.devices_ranked", ["e2_devices_ranked"], ""),
    "E3": ("capacity.least_loaded(n)", ["e3_top_nodes"], ""),
    "E4": ("capacity.assign_nodes, capacity_bands, water_level, ranking.rank_by_id", ["e4_assign_nodes"], "greedy-loop test, property test"),
    "E5": ("metrics.failure_runs (ranking.running_by_key)", ["e5_failure_runs", "e5_failure_runs_by_count"], ""),
    "E6": ("entitlements.transfer_gaps (ranking.lag_by_key)", ["e6_transfer_gaps", "e6_transfer_gaps_by_count"], ""),
    "E7": ("metrics.counter_samples, counter_rate", ["e7_counter_rate"], "reset fixture"),
    "F1": ("capacity.endpoint_set", ["f1_endpoint_set"], ""),
    "F2": ("capacity.known_keys", ["f2_known_keys"], ""),
    "F3": ("siteaudit.audit_pages.distinct_links, page_links", ["k8_links"], ""),
    "G1": ("entitlements.fold_states, state_history, licence_records",
           ["g1_fold_states", "g1_state_history", "g1_licence_records", "g1_table_licence", "g1_table_licence_history",
            "g1_table_slot", "g1_table_slot_history"], "state-grid, random and property tests"),
    "G2": ("entitlements.upsert_devices", ["g2_upsert_devices"], ""),
    "G3": ("entitlements.first_claim", ["g3_first_claim"], ""),
    "G4": ("entitlements.apply_transfers", ["g4_apply_transfers"], ""),
    "G5": ("entitlements.renew_expiry", ["g5_renew_expiry"], "Feb 29 fixture"),
    "G6": ("entitlements.latest_plan", ["g6_latest_plan"], ""),
    "G7": ("entitlements.keys_to_revoke", ["g7_keys_to_revoke"], ""),
    "G8": ("entitlements.keys_to_provision", ["g8_keys_to_provision"], ""),
    "G9": ("entitlements.clear_keys", ["g9_clear_keys"], ""),
    "G10": ("entitlements.retry_step", ["g10_retry_step"], ""),
    "H1": ("streaming.dedup_events, dedup_events_batch", ["h1_dedup_events", "h1_stream_dedup"], "stream = batch test"),
    "H2": ("streaming.stream_states (licences.LicenceProcessor)", ["h2_stream_states"], "random splits, hot key, eviction"),
    "H3": ("metrics.rate_violations, rate_limit_audit", ["h3_rate_violations", "h3_limiter_groups", "h3_service_limits"], ""),
    "H4": ("metrics.windowed_counts, streaming.counter_stream", ["h4_counter_windows"], ""),
    "H5": ("metrics.windowed_counts(slide), streaming.rate_stream", ["h5_sliding_rate", "h5_sliding_rate_scrape"], ""),
    "H6": ("streaming.claim_timeouts, claim_timeouts_batch", ["h6_claim_timeouts"], "stream = batch under random splits"),
    "H7": ("streaming.devices: stream_devices, compact, vacuum, read_devices", ["h7_device_deltas", "h7_stream_devices"], "stream = G2 test, compaction test"),
    "H8": ("metrics.alerts, ratio_alerts", ["h8_alerts", "h8_ratio_alerts"], ""),
    "H9": ("streaming.log_windows, late.account_windows", ["h9_stream_windows"], "late-row tests"),
    "K1": ("siteaudit.audit_pages.has_doctype", ["k1_k2_structure"], ""),
    "K2": ("siteaudit.audit_pages.has_lang/has_charset/has_viewport", ["k1_k2_structure"], ""),
    "K3": ("siteaudit.audit_pages.title/description", ["k3_title_description"], ""),
    "K4": ("siteaudit.audit_pages.canonical", ["k4_canonical"], ""),
    "K5": ("siteaudit.audit_pages.missing_tags", ["k5_social_tags"], ""),
    "K6": ("siteaudit.audit_pages.jsonld/n_bad_jsonld", ["k6_jsonld"], ""),
    "K7": ("siteaudit.jsonld_types, jsonld_types_strict", ["k7_jsonld_types", "k7_jsonld_types_strict"], ""),
    "K8": ("siteaudit.audit_pages.links, page_links", ["k8_links"], ""),
    "K9": ("siteaudit.audit_pages.assets", ["k9_assets"], ""),
    "K10": ("siteaudit.broken_links, resolve_links", ["k10_broken_links"], "relative-path fixture"),
    "K11": ("siteaudit.missing_assets", ["k11_missing_assets"], ""),
    "K12": ("siteaudit.link_classes", ["k12_link_classes"], ""),
    "K13": ("siteaudit.plan_values", ["k13_plan_values"], ""),
    "K14": ("siteaudit.page_rules", ["k14_page_rules"], ""),
    "K15": ("siteaudit.hreflang_gaps", ["k15_hreflang_gaps"], ""),
    "K16": ("siteaudit.hreflang_completeness, hreflang_returns", ["k16_hreflang_completeness", "k16_hreflang_returns"], ""),
    "K17": ("siteaudit.locale_rules", ["k17_locale_rules"], ""),
    "K18": ("siteaudit.inbound_links", ["k18_inbound_links"], ""),
    "K19": ("siteaudit.required_links, section_links, cross_section_links",
            ["k19_required_links", "k19_section_links", "k19_cross_section_links"], ""),
    "K20": ("siteaudit.content_ranges, heading_density", ["k20_content_ranges", "k20_heading_density"], ""),
    "K21": ("siteaudit.faq_mismatch, faq_answer_mismatch, faq_mismatch_strict", ["k21_faq_mismatch", "k21_faq_answers", "k21_faq_mismatch_json"], ""),
    "K22": ("siteaudit.corpus_consistency", ["k22_corpus_consistency"], ""),
    "K23": ("siteaudit.unsafe_links", ["k23_unsafe_links"], ""),
    "K24": ("siteaudit.url_coverage", ["k24_url_coverage"], ""),
    "K25": ("siteaudit.translation_gaps", ["k25_translation_gaps"], ""),
    "K26": ("siteaudit.key_usage_gaps", ["k26_key_usage_gaps"], ""),
    "K27": ("siteaudit.language_links", ["k27_language_links"], ""),
    "K28": ("siteaudit.audit_scorecard, structure_flags", ["k28_audit_scorecard"], ""),
    "L1": ("events.click_counts", ["l1_click_counts"], ""),
    "L2": ("events.funnel, funnel_rates", ["l2_funnel"], ""),
    "L3": ("events.dedup_purchases", ["l3_dedup_purchases"], ""),
    "L4": ("events.time_between (ranking.exact_percentile)", ["l4_time_between"], ""),
}


COVERAGE["A5"][1].append("a5_billing_pipeline")
for _k, (_, _names, _) in COVERAGE.items():  # the audits once more, on the site view
    if _k.startswith("K"):
        from tollgate.plans.registry import queries as _queries
        _names += [f"{n}_site" for n in list(_names) if f"{n}_site" in _queries()]


def render():
    from tollgate.plans.registry import oracle_sql, queries
    qs, orc = queries(), oracle_sql()
    out = ["# Coverage of SURVEY section 2", "",
           "Every inventory ID, the functions that implement it (package `tollgate`), the registered",
           "queries that run it on the driver's tables, and whether each has a DuckDB oracle.", "",
           "| ID | functions | registered queries (oracle) | notes |", "|---|---|---|---|"]
    for k, (fn, names, note) in COVERAGE.items():
        q = ", ".join(f"`{n}` ({'yes' if n in orc else 'rows only'})" for n in names) or "—"
        out.append(f"| {k} | {fn} | {q} | {note} |")
    missing = sorted(set(qs) - {n for _, ns, _ in COVERAGE.values() for n in ns})
    if missing:
        out += ["", "Registered queries not listed above: " + ", ".join(f"`{m}`" for m in missing)]
    return "\n".join(out) + "\n"


if __name__ == "__main__":
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "COVERAGE.md")
    open(path, "w").write(render())
