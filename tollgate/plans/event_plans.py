"""Registered product-event queries (L) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.operators import events as L
from tollgate.plans.registry import register


@register("l1_click_counts", oracle="""
SELECT event_type, json_extract_string(props, '$.k') AS subject, count(*) AS clicks
FROM events WHERE event_type = 'click' GROUP BY 1, 2""")
def l1(c):
    return L.click_counts(c.events, {"event_type": F.col("event_type"),
                                     "subject": F.get_json_object("props", "$.k")})


_STEP = """s{i} AS (SELECT e.user_id, arg_min(e.value, (e.ts, e.event_id)) AS v, min((e.ts, e.event_id))[1] AS t
  FROM events e {join} WHERE e.event_type = '{name}' {cond} GROUP BY e.user_id)"""
_STEPS = ("view", "click", "purchase")


def _funnel_sql():
    ctes = []
    for i, s in enumerate(_STEPS, 1):
        if i == 1:
            ctes.append(_STEP.format(i=i, join="", name=s, cond=""))
        else:
            ctes.append(_STEP.format(i=i, join=f"JOIN s{i-1} p ON p.user_id = e.user_id", name=s,
                                     cond="AND e.ts >= p.t"))
    sel = "\nUNION ALL ".join(f"SELECT {i} AS step_no, '{s}' AS step, count(*) AS users, sum(v) AS value FROM s{i}"
                              for i, s in enumerate(_STEPS, 1))
    return ("WITH " + ",\n".join(ctes) + f",\nf AS ({sel})\n"
            "SELECT *, users / lag(users) OVER (ORDER BY step_no) AS from_prev,\n"
            " users / first_value(users) OVER (ORDER BY step_no) AS from_first FROM f")


@register("l2_funnel", oracle=_funnel_sql(), headline=True)
def l2(c):
    return L.funnel_rates(L.funnel(c.events, _STEPS))


@register("l3_dedup_purchases", oracle="""
SELECT transaction_id, r[1] AS ts, r[2] AS event_id, r[3] AS user_id, r[4] AS event_type, r[5] AS value, r[6] AS props
FROM (SELECT CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k') AS transaction_id,
  min((ts, event_id, user_id, event_type, value, props)) AS r FROM events WHERE event_type = 'purchase' GROUP BY 1) t""")
def l3(c):
    txn = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.get_json_object("props", "$.k"))
    return L.dedup_purchases(c.events, txn)


@register("l4_time_between", oracle="""
WITH a AS (SELECT user_id, min((ts, event_id))[1] AS t FROM events WHERE event_type = 'signup' GROUP BY user_id),
b AS (SELECT e.user_id, min((e.ts, e.event_id))[1] AS t FROM events e JOIN a ON a.user_id = e.user_id
  WHERE e.event_type = 'purchase' AND e.ts >= a.t GROUP BY e.user_id),
d AS (SELECT a.user_id, epoch(b.t) - epoch(a.t) AS seconds FROM a LEFT JOIN b USING (user_id))
SELECT 'users_a' AS metric, CAST(count(*) AS DOUBLE) AS value FROM d
UNION ALL SELECT 'users_b', CAST(count(seconds) AS DOUBLE) FROM d
UNION ALL SELECT 'share_within', count(*) FILTER (WHERE seconds <= 86400.0) / count(seconds) FROM d
UNION ALL SELECT 'median_seconds', quantile_cont(seconds, 0.5) FROM d""")
def l4(c):
    return L.time_between(c.events, "signup", "purchase", 86400.0)
