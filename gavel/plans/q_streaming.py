"""Registered queries: streaming forms (STR-*) checked against the same
oracles as their batch twins."""

from __future__ import annotations

from gavel.plans import q_analytics, q_governance, q_tasks
from gavel.sources.bridges import oracle_cte
from gavel.streaming import jobs as J

QUERIES = {
    "str01_governed_stream": J.governed_stream,
    "str02_decision_counts_stream": J.decision_counts_stream,
    "str02_windowed_decision_counts": J.windowed_decision_counts_stream,
    "str03_risk_coverage_stream": J.risk_coverage_stream,
    "str04_limiter_stream": J.limiter_stream,
    "str05_session_stream": J.session_stream,
    "str06_status_upsert_stream": J.status_upsert_stream,
    "str07_dedupe_stream": J.dedupe_stream,
}

ORACLE = {
    "str01_governed_stream": q_governance.ORACLE["met15_governed_eval"],
    "str02_decision_counts_stream": oracle_cte("b_eval") + """
SELECT final_decision, CAST(count(*) AS BIGINT) AS n FROM b_eval GROUP BY final_decision""",
    "str02_windowed_decision_counts": oracle_cte("b_eval").replace(
        "SELECT 'li__'", "SELECT l_shipdate AS event_time, 'li__'", 1) + """
SELECT strftime(time_bucket(INTERVAL '30 days', event_time, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
       final_decision, CAST(count(*) AS BIGINT) AS n
FROM b_eval GROUP BY 1, 2""",
    "str03_risk_coverage_stream": q_analytics.ORACLE["agg04_risk_coverage"],
    "str04_limiter_stream": q_tasks.ORACLE["biz01_rate_limiter"],
    "str05_session_stream": q_tasks.ORACLE["biz09_session_ops"],
    "str06_status_upsert_stream": q_analytics.ORACLE["win04_status_last_wins"],
    "str07_dedupe_stream": oracle_cte("b_status_raw") + """
SELECT DISTINCT instance_id FROM b_status_raw""",
}
