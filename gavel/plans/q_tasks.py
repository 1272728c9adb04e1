"""Registered queries: the re-aimed task suite (BIZ-1..11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.crypto import _pads
from gavel.operators import tasks as B
from gavel.plans import sqltext as Q
from gavel.sources.bridges import DEMO_KEY, bridge, oracle_cte

QUERIES: dict = {}
ORACLE: dict = {}

PREFIX = "Customer#0000001"


def register(name, oracle=None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _duck_hmac(msg: str) -> str:
    ipad, opad = _pads(DEMO_KEY.encode())
    return f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || encode({msg}))))"


# ------------------------------------------------------------------ BIZ-1
W, L = K.LIMITER_WINDOW, K.LIMITER_LIMIT


@register("biz01_rate_limiter", oracle_cte("b_limiter", recursive=True) + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_unit, event_id) AS rn FROM b_limiter),
walk(user_id, rn, event_id, ts_unit, allowed, kept) AS (
  SELECT user_id, rn, event_id, ts_unit, true, [ts_unit] FROM r WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.rn, r.event_id, r.ts_unit,
         len(list_filter(w.kept, lambda k: k > r.ts_unit - {W})) < {L},
         CASE WHEN len(list_filter(w.kept, lambda k: k > r.ts_unit - {W})) < {L}
              THEN list_append(list_filter(w.kept, lambda k: k > r.ts_unit - {W}), r.ts_unit)
              ELSE list_filter(w.kept, lambda k: k > r.ts_unit - {W}) END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT event_id, user_id, ts_unit, allowed FROM walk""")
def biz01(spark, sf):
    return B.greedy_rate_limit(bridge(spark, sf, "b_limiter")).select("event_id", "user_id", "ts_unit", "allowed")


# ------------------------------------------------------------------ BIZ-2
_PLANS = ", ".join(f"('{p}', {inc}, CAST('{rate}' AS DECIMAL(18,6)), CAST('{base}' AS DECIMAL(18,6)))"
                   for p, inc, rate, base in K.BILLING_PLANS)


@register("biz02_billing", oracle_cte("b_usage") + f""",
plans(plan, included, rate, base) AS (VALUES {_PLANS})
SELECT u.account, u.month, u.plan, u.calls,
       CASE WHEN u.calls >= 0 AND p.included IS NOT NULL THEN
         CAST(CAST(round(p.base + CAST(greatest(u.calls - p.included, 0) AS DECIMAL(20,0)) * p.rate, 2) AS DECIMAL(18,2))
              AS DOUBLE) END AS amount,
       CASE WHEN u.calls < 0 THEN 'calls must be non-negative' WHEN p.included IS NULL THEN 'unknown plan' END AS error
FROM b_usage u LEFT JOIN plans p ON p.plan = lower(u.plan)""")
def biz02(spark, sf):
    return B.monthly_bills(bridge(spark, sf, "b_usage")).withColumn("amount", F.col("amount").cast("double"))


# ------------------------------------------------------------------ BIZ-3
_TYPES = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in K.UPLOAD_TYPES)


@register("biz03_uploads", oracle_cte("b_uploads") + f""",
x AS (SELECT *, CASE lower(string_split(filename, '.')[-1]) {_TYPES} END AS expected FROM b_uploads)
SELECT page_id, filename, content_type, size_bytes,
       coalesce(filename IS NOT NULL AND content_type IS NOT NULL AND filename <> '' AND contains(filename, '.')
                AND size_bytes > 0 AND size_bytes <= {K.UPLOAD_MAX_BYTES} AND expected IS NOT NULL
                AND lower(content_type) = lower(expected), false) AS valid
FROM x""")
def biz03(spark, sf):
    return B.validate_uploads(bridge(spark, sf, "b_uploads"))


# ------------------------------------------------------------------ BIZ-4
@register("biz04_prefix_search", oracle_cte("b_users") + f"""
SELECT c_custkey, username FROM b_users WHERE username LIKE '{PREFIX}%'""")
def biz04(spark, sf):
    return B.prefix_search(bridge(spark, sf, "b_users"), PREFIX).select("c_custkey", "username")


# ------------------------------------------------------------------ BIZ-5
@register("biz05_login", oracle_cte("b_users", "b_attempts") + """
SELECT a.attempt_id, a.username,
       CASE WHEN u.username IS NULL OR u.password_hash IS NULL THEN 'invalid_credentials'
            WHEN u.password_hash <> sha256(a.password) THEN 'invalid_credentials'
            WHEN NOT coalesce(u.is_active, false) THEN 'inactive_user' ELSE 'ok' END AS result
FROM b_attempts a LEFT JOIN b_users u ON u.username = a.username""")
def biz05(spark, sf):
    return B.check_credentials(bridge(spark, sf, "b_attempts"), bridge(spark, sf, "b_users")).select(
        "attempt_id", "username", "result")


# ------------------------------------------------------------------ BIZ-6
@register("biz06_reset_tokens", oracle_cte("b_limiter") + f""",
m AS (SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS uid, ts_unit * 14400 AS issued_at FROM b_limiter)
SELECT event_id, uid, issued_at,
       rtrim(translate(to_base64(unhex({_duck_hmac("uid || ':' || CAST(issued_at AS VARCHAR)")})), '+/', '-_'), '=')
         AS token
FROM m""")
def biz06(spark, sf):
    m = bridge(spark, sf, "b_limiter").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        (F.col("ts_unit") * 14400).alias("issued_at"))
    return B.reset_tokens(m, DEMO_KEY, user="uid", issued="issued_at")


# ------------------------------------------------------------------ BIZ-7
@register("biz07_bearer", oracle_cte("b_bearer") + f""",
p AS (SELECT request_id, auth_header AS h, position(' ' IN auth_header) AS sp FROM b_bearer),
t AS (SELECT *, CASE WHEN sp > 0 THEN substring(h, 1, sp - 1) END AS scheme,
             CASE WHEN sp > 0 THEN {Q.strip('substring(h, sp + 1)')} END AS token FROM p),
u AS (SELECT *, regexp_extract(token, '(?s)^(.*)[.]', 1) AS uid,
             CASE WHEN contains(token, '.') THEN string_split(token, '.')[-1] ELSE token END AS sig FROM t),
r AS (SELECT *, CASE WHEN h IS NULL OR h = '' THEN 'missing_authorization'
                     WHEN sp = 0 OR scheme <> 'Bearer' THEN 'invalid_authorization_format'
                     WHEN token = '' THEN 'empty_token'
                     WHEN NOT contains(token, '.') THEN 'invalid_token_format'
                     WHEN uid = '' OR sig = '' THEN 'invalid_token_parts'
                     WHEN sig <> {_duck_hmac('uid')} THEN 'invalid_token_signature' END AS error FROM u)
SELECT request_id, error, CASE WHEN error IS NULL THEN uid END AS user_id FROM r""")
def biz07(spark, sf):
    return B.verify_bearer(bridge(spark, sf, "b_bearer").drop("user_id"), DEMO_KEY).select(
        "request_id", "error", "user_id")


# ------------------------------------------------------------------ BIZ-8
@register("biz08_audit_fanout", oracle_cte("b_actions") + """
SELECT event_id, user_id, action, 0 AS n, 'USER_ACTION' AS type,
       'user=' || CAST(user_id AS VARCHAR) || ' action=' || action AS message FROM b_actions
UNION ALL
SELECT event_id, user_id, action, 1, 'AUDIT_TRAIL', 'user=' || CAST(user_id AS VARCHAR) || ' action=' || action
FROM b_actions""")
def biz08(spark, sf):
    return B.audit_fanout(bridge(spark, sf, "b_actions"))


# ------------------------------------------------------------------ BIZ-9 (oracle: recursive CTE per chain)
_SESSION_WALK = oracle_cte("b_session_log", recursive=True) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS rn FROM b_session_log),
walk(chain_id, rn, seq, op, sid, owner, live_after, error, ids, owners) AS (
  SELECT chain_id, rn, seq, op, step.sid, step.owner, step.live_after, step.error, step.ids, step.owners
  FROM (SELECT r.*, {step} AS step FROM r, (SELECT CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS owners) s0
        WHERE rn = 1) f
  UNION ALL
  SELECT chain_id, rn, seq, op, step.sid, step.owner, step.live_after, step.error, step.ids, step.owners
  FROM (SELECT r.*, {step_w} AS step FROM walk w JOIN r ON r.chain_id = w.chain_id AND r.rn = w.rn + 1) n)"""

_POS = "list_position({ids}, r.session_id)"


def _step(ids: str, owners: str) -> str:
    pos = _POS.format(ids=ids)
    keep = f"list_filter({ids}, lambda x, i: i <> coalesce({pos}, -1))"
    keep_o = f"list_filter({owners}, lambda x, i: i <> coalesce({pos}, -1))"
    return f"""CASE
      WHEN r.op = 'create' THEN {{'sid': r.session_id, 'owner': r.user_id, 'live_after': true, 'error': NULL::VARCHAR,
                               'ids': list_append({ids}, r.session_id), 'owners': list_append({owners}, r.user_id)}}
      WHEN r.op = 'invalidate' THEN {{'sid': r.session_id, 'owner': CASE WHEN {pos} > 0 THEN {owners}[{pos}] END,
                               'live_after': false, 'error': NULL::VARCHAR, 'ids': {keep}, 'owners': {keep_o}}}
      WHEN coalesce({pos}, 0) = 0 THEN {{'sid': r.new_session_id, 'owner': NULL::VARCHAR, 'live_after': false,
                               'error': 'unknown session id', 'ids': {ids}, 'owners': {owners}}}
      ELSE {{'sid': r.new_session_id, 'owner': {owners}[{pos}], 'live_after': true, 'error': NULL::VARCHAR,
             'ids': list_append({keep}, r.new_session_id), 'owners': list_append({keep_o}, {owners}[{pos}])}} END"""


_WALK_SQL = _SESSION_WALK.replace("{step}", _step("s0.ids", "s0.owners")).replace("{step_w}", _step("w.ids", "w.owners"))


@register("biz09_session_ops", _WALK_SQL + """
SELECT CAST(chain_id AS BIGINT) AS chain_id, CAST(seq AS BIGINT) AS seq, op, sid AS session_id, owner, live_after, error
FROM walk""")
def biz09b(spark, sf):
    return B.session_ops(bridge(spark, sf, "b_session_log"))


@register("biz09_live_sessions", _WALK_SQL + """,
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY rn DESC) = 1)
SELECT unnest(ids) AS session_id, CAST(chain_id AS BIGINT) AS chain_id, unnest(owners) AS user_id FROM last""")
def biz09(spark, sf):
    return B.live_sessions(bridge(spark, sf, "b_session_log"))


# ------------------------------------------------------------------ BIZ-10
_LEDGER_CHECK = """
chk AS (SELECT t.*, CASE WHEN t.amount IS NULL OR t.amount <= 0 THEN 'non_positive_amount'
                         WHEN a.owner_id IS NULL OR b.account_id IS NULL THEN 'unknown_account'
                         WHEN a.owner_id <> t.actor THEN 'not_owner' END AS rejection
        FROM b_transfers t LEFT JOIN b_accounts a ON a.account_id = t.source
        LEFT JOIN b_accounts b ON b.account_id = t.target)"""


@register("biz10_ledger_checks", oracle_cte("b_accounts", "b_transfers") + "," + _LEDGER_CHECK + """
SELECT seq, actor, source, target, CAST(amount AS DOUBLE) AS amount, rejection FROM chk""")
def biz10(spark, sf):
    checked, _ = B.ledger_audit(bridge(spark, sf, "b_transfers"), bridge(spark, sf, "b_accounts"))
    return checked.select("seq", "actor", "source", "target", F.col("amount").cast("double").alias("amount"),
                          "rejection")


@register("biz10_ledger_postings", oracle_cte("b_accounts", "b_transfers") + "," + _LEDGER_CHECK + """,
post AS (SELECT seq, source AS account_id, -amount AS delta, 'debit' AS kind, 0 AS n FROM chk WHERE rejection IS NULL
         UNION ALL SELECT seq, target, amount, 'credit', 1 FROM chk WHERE rejection IS NULL),
bal AS (SELECT p.*, a.balance + sum(p.delta) OVER (PARTITION BY p.account_id ORDER BY p.seq, p.n
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
        FROM post p LEFT JOIN b_accounts a ON a.account_id = p.account_id)
SELECT seq, account_id, CAST(delta AS DOUBLE) AS delta, kind, CAST(after AS DOUBLE) AS balance_after,
       after < 0 AS overdrawn FROM bal""")
def biz10b(spark, sf):
    _, ledger = B.ledger_audit(bridge(spark, sf, "b_transfers"), bridge(spark, sf, "b_accounts"))
    return ledger.select("seq", "account_id", F.col("delta").cast("double").alias("delta"), "kind",
                         F.col("balance_after").cast("double").alias("balance_after"), "overdrawn")


# ------------------------------------------------------------------ BIZ-11
def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {Q.q(a)}, {Q.q(b)})"
    return x


@register("biz11_render_profiles", oracle_cte("b_profiles") + f"""
SELECT page_id, '<div class="profile"><h1>' || {_esc('username')} || '</h1><p>' || {_esc('bio')} || '</p></div>' AS html
FROM b_profiles""")
def biz11(spark, sf):
    return B.render_profiles(bridge(spark, sf, "b_profiles")).select("page_id", "html")
