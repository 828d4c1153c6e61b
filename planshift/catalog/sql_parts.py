"""Common table expressions of the checking SQL: the same stand-in inputs, written once."""

from __future__ import annotations

from planshift.sources.standins import KINDS, WINDOWS

CHANNELS = ("web", "mobile")
COUNTERS = [f"{c}_{k}" for c in (*CHANNELS, "total") for k in KINDS]


def _count(channel: str, kind: str) -> str:
    where = f"kind = '{kind}'" if channel == "total" else f"kind = '{kind}' AND channel = '{channel}'"
    return f"count(*) FILTER (WHERE {where}) AS {channel}_{kind}"


def trailing(metrics, windows) -> str:
    return ",\n".join(
        f"CAST(sum({m}) OVER (PARTITION BY account_id ORDER BY day "
        f"RANGE BETWEEN INTERVAL {k - 1} DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS {m}_l{k}d"
        for m in metrics
        for k in windows
    )


SINCE_LAST = (
    "CAST(day - lag(day) OVER (PARTITION BY account_id ORDER BY day) AS BIGINT) AS since_last"
)

PARTS = {
    "ev": """
        SELECT event_id, user_id AS account_id, CAST(ts AS DATE) AS day, event_type AS kind,
               CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0
                    THEN 'web' ELSE 'mobile' END AS channel, value
        FROM events""",
    "daily": "SELECT account_id, day, "
    + ", ".join(_count(c, k) for c in (*CHANNELS, "total") for k in KINDS)
    + " FROM ev GROUP BY account_id, day",
    "wide": f"SELECT *, {trailing(COUNTERS, WINDOWS)}, {SINCE_LAST} FROM daily",
    "buys": "SELECT DISTINCT account_id, day FROM ev WHERE kind = 'purchase'",
    "visits": """
        SELECT account_id, day AS visit_day, count(*) AS visits,
               count(*) FILTER (WHERE kind = 'view') AS pages
        FROM ev WHERE kind IN ('view', 'click') GROUP BY account_id, day""",
    "flags_web": "SELECT account_id, day AS visit_day, "
    + ", ".join(f"max(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS {k}_flag" for k in KINDS)
    + " FROM ev WHERE channel = 'web' GROUP BY account_id, day",
    "flags_mobile": "SELECT account_id, day AS visit_day, "
    + ", ".join(f"max(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS {k}_flag" for k in KINDS)
    + " FROM ev WHERE channel = 'mobile' GROUP BY account_id, day",
    "attrs": """
        SELECT c_custkey AS account_id, CAST(floor(c_acctbal / 100) AS BIGINT) AS tenure, c_mktsegment AS mix
        FROM customer""",
    "yearly": """
        SELECT o_custkey AS account_id, CAST(year(o_orderdate) AS VARCHAR) AS ym,
               arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS tier,
               arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
               count(*) AS product_count, max(o_totalprice) AS top, min(o_totalprice) AS low,
               count(*) FILTER (WHERE o_orderstatus <> 'F') AS open_orders
        FROM orders GROUP BY 1, 2""",
    "snap": """
        SELECT account_id, ym, tier, status, CASE WHEN top >= 10000 THEN 1 ELSE 0 END AS video_units,
               product_count, CASE WHEN top < 495000 THEN 1 ELSE 0 END AS residential,
               CASE WHEN open_orders = 0 THEN 1 ELSE 0 END AS disconnected,
               CASE WHEN tier <> '4-NOT SPECIFIED' THEN CASE WHEN low < 1500 THEN 1 ELSE 0 END END AS courtesy,
               CASE tier WHEN '5-LOW' THEN 10 WHEN '3-MEDIUM' THEN 20 WHEN '2-HIGH' THEN 30
                         WHEN '1-URGENT' THEN 40 END AS tier_rank
        FROM yearly""",
    "eligible": """
        SELECT m0.account_id, m0.tier AS tier_m0, m1.tier AS tier_m1,
               m0.tier_rank AS rank_m0, m1.tier_rank AS rank_m1, m0.product_count AS products
        FROM snap m0 JOIN snap m1 ON m0.account_id = m1.account_id AND m0.ym = '1998' AND m1.ym = '1997'
        WHERE m0.status IN ('O', 'P') AND m1.status IN ('O', 'P')
          AND m0.video_units = 1 AND m1.video_units = 1
          AND m0.product_count > 0 AND m1.product_count > 0
          AND m0.residential = 1 AND m0.disconnected = 0 AND m0.courtesy <> 1""",
    "changes": """
        SELECT account_id, CASE WHEN rank_m0 > rank_m1 THEN 1 ELSE 0 END AS upgraded,
               tier_m0 AS tier_to, tier_m1 AS tier_from FROM eligible""",
    "sold": """
        SELECT DISTINCT l_orderkey AS account_number, CAST(l_shipdate AS DATE) AS day,
               l_returnflag AS sub_task, p_brand AS channel, p_name AS task, p_type AS product_mix,
               o_custkey AS account_id
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "sales": """
        SELECT DISTINCT account_id, account_number, day, product_mix FROM sold
        WHERE day >= DATE '1998-01-01' AND day < DATE '1999-01-01' AND channel LIKE 'Brand#1%'
          AND task LIKE '%o%' AND sub_task = 'R'""",
    "labels_": """
        SELECT DISTINCT s.account_id, account_number, day, strftime(day, '%Y%m') AS year_month,
               tier_to, tier_from, product_mix
        FROM sales s JOIN changes c ON s.account_id = c.account_id WHERE upgraded = 1""",
    "trail": f"""
        SELECT *, {trailing(['total_view', 'total_click', 'total_error', 'total_signup'], (3, 7))},
               {SINCE_LAST} FROM daily""",
    "matrix": """
        SELECT t.account_id, t.day,
               CASE WHEN t.day < DATE '2024-01-09' THEN 'oot1' WHEN t.day <= DATE '2024-01-22' THEN 'dev'
                    ELSE 'oot2' END AS sample,
               web_view, web_click, mobile_view, mobile_click, total_view_l3d, total_view_l7d,
               total_click_l3d, total_click_l7d, total_error_l7d, total_signup_l7d,
               coalesce(since_last, 0) AS since_last,
               coalesce(CASE WHEN tenure > 74 THEN 75 ELSE tenure END, 0) AS tenure,
               CASE mix WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                        WHEN 'HOUSEHOLD' THEN 4 ELSE 0 END AS mix_code,
               CASE WHEN total_purchase > 0 THEN 1 ELSE 0 END AS target
        FROM trail t LEFT JOIN attrs a ON t.account_id = a.account_id""",
    "points": """
        SELECT *, 3 * total_click_l7d + 2 * total_view_l3d + mix_code + web_view * 5 AS points FROM matrix""",
    "scored": """
        SELECT account_id, day, sample, target, mix_code, CASE WHEN points >= 20 THEN 1 ELSE 0 END AS pred,
               points / (points + 20.0) AS p FROM points""",
}

NEEDS = {
    "daily": ["ev"], "wide": ["daily"], "buys": ["ev"], "visits": ["ev"], "flags_web": ["ev"],
    "flags_mobile": ["ev"], "snap": ["yearly"], "eligible": ["snap"], "changes": ["eligible"],
    "sales": ["sold"], "labels_": ["sales", "changes"], "trail": ["daily"],
    "matrix": ["trail", "attrs"], "points": ["matrix"], "scored": ["points"],
}


def given(*names: str, more: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named parts and all they need, then the extra ones of ``more``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({PARTS[n]})" for n in ordered] + [f"{n} AS ({s})" for n, s in (more or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
