"""Bridges: governance tables derived deterministically from the shared
parquet tables, so every registered query reads (and scales with) them.

Each bridge is one SQL text valid in Spark SQL and DuckDB alike; the only
dialect differences (array constructors) are template slots. Spark runs it
through ``spark.sql(text, **frames)`` with DataFrame arguments, so no global
view names are created; the oracle inlines the same text as a CTE.

Definitions (doc = documents row, d = doc_id):
  b_preds      id 'doc__d', seq d, provider = source, tau_step 1 + d%3. Raw
               patch by d: %17 '' | %19 docker timeout text | %23 plain
               timeout text | %29 the diff fenced inside prose | %31 the diff
               indented by four | else the diff. The diff adds the document
               to src/<source>.py (tests/test_<source>.py when d%5=0) as
               raw prose (d%3=0), as '# ' comments plus 'import random'
               (d%3=1) or as comments plus a token assignment (d%3=2).
  b_results    labels: resolved = quality=1 (null when d%5=0); status
               PATCH_APPLY_FAILED (toxic) / RESOLVED / UNRESOLVED, null when
               d%7=0, lower-cased when d%13=0.
  b_status_raw events as exit-status writes: id 'doc__(user*5 + event%5)',
               file by day, position by (ts, event_id), status by type.
  b_reports    every 4th document: scope, failed/ok flags, error text and
               finding lists by d; d%44=0 is an unreadable report.
  b_eval       lineitem rows as governed eval rows (bench scale).
  b_iter       lineitem rows as tau iteration traces (run = order); Spark
               builds the same rows in ``iteration_rows``.
  b_cands      lineitem rows as best-of-K candidates (instance = part).
  b_loop       orders as task-loop rows (baseline / wrapped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"arr": "array", "empty": "CAST(array() AS ARRAY<STRING>)", "nullarr": "CAST(NULL AS ARRAY<STRING>)",
         "epoch": "(unix_date(CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))", "month": "date_format(ts, 'yyyy-MM')",
         "h1": "sha2(", "h2": ", 256)", "div12": "(doc_id div 12)",
         "js1": "regexp_replace(to_json(array(", "js2": ")), '^.|.$', '')"}
DUCK = {"arr": "list_value", "empty": "CAST([] AS VARCHAR[])", "nullarr": "CAST(NULL AS VARCHAR[])",
        "epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "month": "strftime(ts, '%Y-%m')",
        "h1": "sha256(", "h2": ")", "div12": "(doc_id // 12)",
        "js1": "CAST(to_json(", "js2": ") AS VARCHAR)"}

LIMITER_UNIT = 14400  # seconds of the limiter bridge's time unit

# fixed value: the demo signing key used by the bearer/reset-token bridges
DEMO_KEY = "bridge-secret"

_DIFF_BODY = """
  SELECT doc_id, source, text,
         CASE WHEN doc_id % 5 = 0 THEN 'tests/test_' || source || '.py' ELSE 'src/' || source || '.py' END AS path,
         CASE doc_id % 3
           WHEN 0 THEN text
           WHEN 1 THEN '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || 'import random'
           ELSE '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || 'token = "'
                || CASE WHEN doc_id % 7 = 0 THEN 'example_' ELSE 'sk_live_' END || CAST(doc_id AS STRING) || '"'
         END AS body
  FROM {documents}
"""

BRIDGES: dict[str, tuple[tuple[str, ...], str]] = {
    "b_preds": (("documents",), """
SELECT 'doc__' || CAST(doc_id AS STRING) AS instance_id, doc_id AS seq, source AS provider,
       1 + doc_id % 3 AS tau_step, doc_id % 3 AS form,
       CASE WHEN doc_id % 17 = 0 THEN ''
            WHEN doc_id % 19 = 0 THEN 'Error: docker container start timed out after 120 seconds'
            WHEN doc_id % 23 = 0 THEN 'Command timed out after 300 seconds'
            WHEN doc_id % 29 = 0 THEN 'Here is the fix:' || chr(10) || '```diff' || chr(10) || diff || '```' || chr(10)
            WHEN doc_id % 31 = 0 THEN '    ' || replace(diff, chr(10), chr(10) || '    ')
            ELSE diff END AS model_patch
FROM (
  SELECT doc_id, source, body,
         'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10)
         || '+++ b/' || path || chr(10) || '@@ -0,0 +1,'
         || CAST(length(body) - length(replace(body, chr(10), '')) + 1 AS STRING) || ' @@' || chr(10)
         || '+' || replace(body, chr(10), chr(10) || '+') || chr(10) AS diff
  FROM (""" + _DIFF_BODY + """) bodies
) diffs
"""),
    "b_results": (("labels",), """
SELECT 'doc__' || CAST(doc_id AS STRING) AS instance_id, doc_id AS seq,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality = 1 END AS resolved,
       CASE WHEN doc_id % 7 = 0 THEN NULL
            WHEN doc_id % 13 = 0 THEN lower(st) ELSE st END AS resolved_status,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1.0 - 0.25 * toxic END AS cri
FROM (SELECT doc_id, quality, toxic,
             CASE WHEN toxic = 1 THEN 'PATCH_APPLY_FAILED' WHEN quality = 1 THEN 'RESOLVED'
                  ELSE 'UNRESOLVED' END AS st
      FROM {labels}) l
"""),
    "b_status_raw": (("events",), """
SELECT 'doc__' || CAST(user_id * 5 + event_id % 5 AS STRING) AS instance_id,
       'exit_statuses_' || CAST(CAST(ts AS DATE) AS STRING) || '.yaml' AS file,
       ts, event_id AS pos,
       CASE event_type WHEN 'purchase' THEN 'Success' WHEN 'error' THEN 'Timeout'
                       WHEN 'signup' THEN 'Submitted' WHEN 'click' THEN 'pending'
                       ELSE 'LimitsExceeded' END AS status
FROM {events}
"""),
    "b_reports": (("documents",), """
SELECT 'doc__' || CAST(doc_id AS STRING) AS instance_id,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'postapply_fullfile_delta_v1' END AS scan_scope,
       doc_id % 24 = 0 AS scan_failed,
       CASE WHEN doc_id % 40 = 0 THEN false WHEN doc_id % 8 = 0 THEN true ELSE NULL END AS scan_ok,
       CASE WHEN doc_id % 24 = 0 AND doc_id % 48 <> 0 THEN 'worktree apply failed' ELSE NULL END AS scan_error,
       CASE CAST(floor(doc_id / 4) AS BIGINT) % 5
         WHEN 0 THEN {empty}
         WHEN 1 THEN {arr}('WEAK_RNG_USAGE')
         WHEN 2 THEN {arr}('[info] HARDCODED_SECRETS')
         WHEN 3 THEN {nullarr}
         ELSE {arr}('NO_TRANSACTION_FOR_MULTI_WRITE', '[info] POTENTIAL_XSS') END AS new_violations,
       doc_id % 44 = 0 AS corrupt
FROM {documents}
WHERE doc_id % 4 = 0
"""),
    "b_eval": (("lineitem",), """
SELECT 'li__' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS task,
       'model_' || CAST(l_suppkey % 3 AS STRING) AS model,
       (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS seq,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL
            WHEN l_returnflag = 'A' THEN 'OK' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'VETO'
            WHEN l_returnflag = 'N' AND l_linenumber % 3 = 0 THEN 'OK'
            ELSE 'ABSTAIN' END AS final_decision,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linestatus = 'F' END AS resolved,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'RESOLVED'
            ELSE 'UNRESOLVED' END AS resolved_status,
       CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE 1.0 - l_discount * 5.0 END AS cri,
       l_returnflag = 'R' AND l_linestatus = 'O' AS sad_flag,
       l_quantity < 4.0 AS security_scan_failed,
       CASE l_linenumber % 3 WHEN 0 THEN 'diff_fragment_fallback_v2'
            WHEN 1 THEN 'postapply_fullfile_delta_v1' ELSE '' END AS security_scan_scope,
       CASE WHEN l_suppkey % 50 = 0 THEN 'infra_timeout_before_patch'
            WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'resolved'
            ELSE 'unresolved' END AS eval_status,
       l_suppkey % 50 = 0 AS infra_timeout_before_patch
FROM {lineitem}
"""),
    "b_iter": (("lineitem",), """
SELECT run, tau_step,
       tt AS total_tests, CASE WHEN ff < tt THEN ff ELSE tt END AS tests_failed,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS n_violations,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN {arr}('SQLI_FSTRING') ELSE {empty} END AS violations,
       CAST(floor(l_tax * 100.0) AS BIGINT) % 4 AS n_lint
FROM (SELECT run, l_returnflag, l_linestatus, l_tax,
             CAST(row_number() OVER (PARTITION BY run ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT)
               AS tau_step,
             CAST(floor(l_quantity) AS BIGINT) % 6 AS tt,
             CAST(floor(l_extendedprice) AS BIGINT) % 3 AS ff
      FROM (SELECT 'run__' || CAST(l_orderkey AS STRING) AS run, * FROM {lineitem}) r) li
"""),
    "b_cands": (("lineitem",), """
SELECT 'p__' || CAST(l_partkey AS STRING) AS instance_id,
       (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS cand_idx,
       'cand_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS candidate_dir,
       l_returnflag = 'A' OR l_linestatus = 'F' AS resolved,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 1.0 - l_discount * 5.0 END AS cri,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN {arr}('HARDCODED_SECRETS') ELSE {empty} END
         AS security_violations,
       l_quantity < 5.0 AS security_scan_failed,
       CAST(l_linenumber % 3 AS BIGINT) AS changed_files,
       CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS patch_size
FROM {lineitem}
"""),
    "b_loop": (("orders",), """
SELECT o_orderpriority AS model, 'task_' || CAST(o_custkey % 40 AS STRING) AS task,
       CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'wrapped' END AS type,
       o_orderkey AS seq,
       tt AS total_tests, CASE WHEN pp < tt THEN pp ELSE tt END AS tests_passed,
       CASE WHEN tt = 0 THEN NULL ELSE CAST(CASE WHEN pp < tt THEN pp ELSE tt END AS DOUBLE) / CAST(tt AS DOUBLE) END
         AS test_pass_rate,
       CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'P' THEN 'VETO' ELSE 'ABSTAIN' END AS final_decision,
       CASE WHEN tt = 0 THEN NULL ELSE CAST(CASE WHEN pp < tt THEN pp ELSE tt END AS DOUBLE) / CAST(tt AS DOUBLE) END
         AS last_test_pass_rate,
       o_orderkey % 4 AS security_violation_count, {arr}(CAST(0.25 AS DOUBLE), CAST(o_orderkey % 100 AS DOUBLE) / 100) AS cri_history,
       CASE WHEN o_orderkey % 3 = 0 THEN {arr}('POTENTIAL_XSS') ELSE {empty} END AS last_security_violations
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
             CAST(floor(o_totalprice) AS BIGINT) % 5 AS tt,
             CAST(floor(o_totalprice / 7.0) AS BIGINT) % 6 AS pp
      FROM {orders}) o
"""),
    "b_limiter": (("events",), """
SELECT event_id, user_id, CAST(floor({epoch} / {unit}) AS BIGINT) AS ts_unit FROM {events}
"""),
    "b_usage": (("events",), """
SELECT 'acct_' || CAST(user_id AS STRING) AS account, {month} AS month,
       CASE user_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'Pro' WHEN 2 THEN 'enterprise' ELSE 'gold' END AS plan,
       CASE WHEN user_id % 29 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(count(*) * 25 AS BIGINT) END AS calls
FROM {events} GROUP BY user_id, {month}
"""),
    "b_uploads": (("pages",), """
SELECT page_id,
       regexp_extract(url, '([^/]*)$', 1) || CASE page_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg'
           WHEN 3 THEN '.pdf' WHEN 4 THEN '.gif' ELSE '' END AS filename,
       CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf'
           WHEN 3 THEN 'IMAGE/PNG' ELSE 'text/html' END AS content_type,
       CAST(length(html) AS BIGINT) * (page_id % 400) AS size_bytes
FROM {pages}
"""),
    "b_users": (("customer",), """
SELECT c_custkey, c_name AS username, {h1}'pw' || CAST(c_custkey AS STRING){h2} AS password_hash,
       c_acctbal > 0 AS is_active
FROM {customer}
"""),
    "b_attempts": (("orders",), """
SELECT o_orderkey AS attempt_id,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Nobody#' || CAST(o_orderkey AS STRING)
            ELSE 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END AS username,
       CASE WHEN o_orderkey % 3 = 0 THEN 'wrong' ELSE 'pw' || CAST(o_custkey AS STRING) END AS password
FROM {orders}
"""),
    "b_actions": (("events",), """
SELECT event_id, user_id, event_type AS action FROM {events}
"""),
    "b_session_log": (("events",), """
SELECT chain_id, k AS seq,
       CASE WHEN k = 1 THEN 'create' WHEN event_type IN ('view', 'click', 'purchase') THEN 'rotate'
            ELSE 'invalidate' END AS op,
       CASE WHEN k = 1 THEN 's' || c || '_1'
            WHEN event_type IN ('purchase', 'signup') THEN 's' || c || '_' || CAST(greatest(k - 2, 1) AS STRING)
            ELSE 's' || c || '_' || CAST(k - 1 AS STRING) END AS session_id,
       CASE WHEN k = 1 THEN 'u' || CAST(user_id AS STRING) END AS user_id,
       CASE WHEN k > 1 AND event_type IN ('view', 'click', 'purchase') THEN 's' || c || '_' || CAST(k AS STRING)
            END AS new_session_id
FROM (SELECT event_type, user_id, user_id * 4 + event_id % 4 AS chain_id,
             CAST(user_id * 4 + event_id % 4 AS STRING) AS c,
             row_number() OVER (PARTITION BY user_id * 4 + event_id % 4 ORDER BY ts, event_id) AS k
      FROM {events}) e
"""),
    "b_accounts": (("customer",), """
SELECT 'acct_' || CAST(c_custkey AS STRING) AS account_id, 'u' || CAST(c_custkey AS STRING) AS owner_id,
       CAST(c_acctbal AS DECIMAL(18,2)) AS balance
FROM {customer}
"""),
    "b_transfers": (("orders",), """
SELECT o_orderkey AS seq,
       CASE WHEN o_orderkey % 13 = 0 THEN 'u' || CAST(o_custkey + 1 AS STRING) ELSE 'u' || CAST(o_custkey AS STRING) END
         AS actor,
       'acct_' || CAST(o_custkey AS STRING) AS source,
       CASE WHEN o_orderkey % 19 = 0 THEN 'acct_missing' ELSE 'acct_' || CAST((o_custkey + o_orderkey) % 100 AS STRING) END
         AS target,
       CASE WHEN o_orderkey % 17 = 0 THEN CAST(-5 AS DECIMAL(18,2))
            ELSE CAST(CAST(floor(o_totalprice / 100.0) AS BIGINT) AS DECIMAL(18,2)) END AS amount
FROM {orders}
"""),
    "b_profiles": (("pages",), """
SELECT page_id, url AS username, html AS bio FROM {pages}
"""),
    "b_bearer": (("events",), """
SELECT event_id AS request_id, user_id,
       CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Token abc' WHEN 2 THEN 'Bearer ' WHEN 3 THEN 'Bearer nodot'
            WHEN 4 THEN 'Bearer .sig' WHEN 5 THEN 'Bearer u' || CAST(user_id AS STRING) || '.badsig'
            ELSE 'Bearer u' || CAST(user_id AS STRING) || '.' || {hmac_u} END AS auth_header
FROM {events}
"""),
    "b_traj": (("conversations",), """
SELECT conv_id, 'conv_' || CAST(conv_id AS STRING) AS instance_id,
       CASE WHEN conv_id % 13 = 0 THEN ''
            WHEN conv_id % 11 = 0 THEN ' no_patch '
            WHEN conv_id % 3 = 0 THEN 'diff --git a/m.py b/m.py' || chr(10) || '--- a/m.py' || chr(10) || '+++ b/m.py'
                 || chr(10) || '@@ -1,1 +1,1 @@' || chr(10) || '-old' || chr(10) || '+' || replace(text, chr(10), ' ')
                 || chr(10) || chr(10)
            WHEN conv_id % 3 = 1 THEN 'Here is the patch:' || chr(10) || '```diff' || chr(10) || '--- a/m.py' || chr(10)
                 || '+++ b/m.py' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' keep' || chr(10) || '+'
                 || replace(text, chr(10), ' ') || chr(10) || '```' || chr(10) || 'Done.'
            ELSE text END AS submission
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
      FROM {conversations} WHERE role = 'assistant') t
WHERE r = 1
"""),
    "b_testlogs": (("lineitem",), """
SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS log_id,
       CASE CAST(floor(l_quantity) AS BIGINT) % 7
         WHEN 0 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) || ' passed in 0.12s'
         WHEN 1 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) || ' passed, '
                     || CAST(l_linenumber AS STRING) || ' failed in 1.0s'
         WHEN 2 THEN CAST(l_linenumber AS STRING) || ' failed, ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING)
                     || ' passed'
         WHEN 3 THEN 'FAILED (failures=' || CAST(l_linenumber AS STRING) || ')'
         WHEN 4 THEN 'all tests PASSED'
         WHEN 5 THEN 'E   SyntaxError: invalid syntax'
         ELSE '' END AS output,
       CAST(l_linenumber % 2 AS BIGINT) AS exit_code
FROM {lineitem}
"""),
    "b_evallogs": (("conversations",), """
SELECT conv_id, turn,
       CASE (conv_id + turn) % 6
         WHEN 0 THEN text || chr(10) || '>>>>> Patch Apply Failed:' || chr(10) || 'patch unexpectedly ends in middle of line'
         WHEN 1 THEN text || chr(10) || 'Only garbage was found in the patch input.'
         WHEN 2 THEN 'Tests ran' || chr(10) || 'resolved: True' || chr(10) || text
         WHEN 3 THEN 'resolved:   False'
         WHEN 4 THEN 'Error building image: manifest unknown'
         ELSE text END AS log_text
FROM {conversations}
"""),
    "b_paths": (("documents",), """
SELECT doc_id,
       CASE doc_id % 8 WHEN 0 THEN 'tests/test_' || source || '.py' WHEN 1 THEN 'pkg/tests/' || source || '.py'
            WHEN 2 THEN 'src/test_' || source || '.py' WHEN 3 THEN 'src/' || source || '_test.py'
            WHEN 4 THEN 'test_' || source || '.py' WHEN 5 THEN 'SRC/Tests/' || source || '.py'
            WHEN 6 THEN '' ELSE 'src/' || source || '.py' END AS path,
       CASE doc_id % 5 WHEN 0 THEN 'Dummy_' || source WHEN 1 THEN ' my-EXAMPLE ' ELSE lower(text) END
         AS value,
       text
FROM {documents}
"""),
    "b_subset": (("documents",), """
SELECT CASE WHEN doc_id % 9 = 4 THEN '# ' || name WHEN doc_id % 9 = 7 THEN '   ' ELSE '  org__' || name || ' ' END AS line, doc_id AS pos
FROM (SELECT doc_id, source || '-' || CAST(doc_id AS STRING) AS name FROM {documents}) x
"""),
    "b_state": (("documents",), """
SELECT 'model-a|' || CASE doc_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN '-SAD' ELSE 'full' END || '|org__' || name || '|r1' AS key,
       CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'done' END AS status, doc_id AS seq
FROM (SELECT doc_id, source || '-' || CAST(doc_id AS STRING) AS name FROM {documents}) x
UNION ALL
SELECT 'model-b|full|org__' || source || '-' || CAST(doc_id AS STRING) || '|r2', 'done', doc_id FROM {documents} WHERE doc_id % 2 = 0
"""),
    "b_code": (("documents",), """
SELECT doc_id, 'src/' || source || '/m' || CAST(doc_id AS STRING) || '.py' AS path, doc_id % 6 AS form, notes,
       CASE doc_id % 6
         WHEN 0 THEN 'cursor.execute("SELECT * FROM t WHERE id=" + uid)'
         WHEN 1 THEN 'q = f"SELECT ' || chr(123) || 'x' || chr(125) || ' FROM t"' || chr(10) || 'password = "hunter22"'
         WHEN 2 THEN '@app.get("/u")' || chr(10) || 'def h(user_id):' || chr(10) || '    return user_id'
         WHEN 3 THEN 'db.save()' || chr(10) || 'obj.update()' || chr(10) || 'el.innerHTML = x'
         WHEN 4 THEN 'import random' || chr(10) || 'api_key = 12345' || chr(10) || 'eval(s); os.system(c)'
         ELSE 'def broken(:' END || chr(10) || notes AS code,
       CASE doc_id % 4 WHEN 3 THEN {empty} WHEN 2 THEN {arr}('SQLI', 'SECRETS')
            ELSE {arr}('SQLI', 'SECRETS', 'MISSING_AUTH', 'NO_TRANSACTION', 'XSS', 'WEAK_RNG') END AS rules
FROM (SELECT doc_id, source, '# ' || replace(text, chr(10), chr(10) || '# ') AS notes FROM {documents}) t
"""),
    "b_index": (("documents",), """
SELECT 'doc__' || CAST(doc_id AS STRING) AS instance_id, 'org/' || source AS repo,
       substring({h1}text{h2}, 1, 12) AS base_commit
FROM {documents} WHERE doc_id % 3 <> 0
"""),
    "b_evalreport": (("labels",), """
SELECT 'doc__' || CAST(doc_id AS STRING) AS instance_id, quality = 1 AS resolved,
       CASE WHEN toxic = 1 THEN false WHEN doc_id % 9 = 0 THEN NULL ELSE true END AS patch_applied
FROM {labels} WHERE doc_id % 2 = 0
"""),
    "b_ctxfiles": (("documents",), """
SELECT 'inst__' || CAST({div12} AS STRING) AS instance_id, doc_id AS pos,
       CASE WHEN doc_id % 4 = 0 THEN 'tests/test_' || CAST(doc_id AS STRING) || '.py'
            WHEN doc_id % 7 = 0 THEN 'docs/' || CAST(doc_id AS STRING) || '.md'
            ELSE 'pkg/m' || CAST(doc_id AS STRING) || '.py' END AS path,
       CASE WHEN doc_id % 4 = 0 THEN 'test' WHEN doc_id % 24 = 1 THEN 'explicit' ELSE 'changed' END AS kind,
       text AS content
FROM {documents}
"""),
}

# Texts of the tool's input files, one row a file (a line for b_resultlines);
# j is a document's text as a JSON string.
BRIDGES |= {
    "b_predfiles": (("documents",), """
SELECT doc_id, text AS t, 'f' || d AS file, CASE doc_id % 8
  WHEN 0 THEN '[{{"instance_id":"a' || d || '","model_patch":' || j || '}}, ' || j || ', {{"task":"t' || d || '","model_patch":null}}]'
  WHEN 1 THEN '{{"m' || d || '": {{"model_patch":' || j || ',"task":"x"}}, "n' || d || '": ' || j || '}}'
  WHEN 2 THEN '{{"id":"s' || d || '","model_patch":' || j || ',"provider":"p"}}'
  WHEN 3 THEN '{{"instance_id":"l' || d || '","model_patch":' || j || '}}' || chr(10) || chr(10) || '{{}}' || chr(10)
              || '[{{"task":"p' || d || '"}},"0"]' || chr(10) || '{{"k' || d || '":' || j || '}}' || chr(10)
  WHEN 4 THEN j WHEN 5 THEN 'null' WHEN 6 THEN ' ' || chr(10)
  ELSE '{{"instance_id":0,"task":"0","model_patch":' || j || '}}' END AS text
FROM (SELECT doc_id, text, CAST(doc_id AS STRING) AS d, {js1}text{js2} AS j FROM {documents}) x
"""),
    "b_statusfiles": (("documents",), """
SELECT doc_id, 'exit_' || CAST(doc_id AS STRING) || '.yaml' AS file, CASE doc_id % 4
  WHEN 0 THEN '{{"instances_by_exit_status":{{"Submitted":["doc__' || u || '","' || v || '"],"error":["' || v || '",null],"odd":"x"}}}}'
  WHEN 1 THEN '{{"doc__' || u || '":"' || source || '","gone":null}}' WHEN 2 THEN '["not a mapping"]'
  ELSE '{{"instances_by_exit_status":"none"}}' END AS text
FROM (SELECT doc_id, source, CAST(doc_id % 300 AS STRING) AS u, lang AS v FROM {documents}) x
"""),
    "b_resultlines": (("documents",), """
SELECT 'results.jsonl' AS file, doc_id + 1 AS line, CASE WHEN doc_id % 10 = 3 THEN '{{not json' WHEN doc_id % 10 = 7 THEN '  '
  WHEN doc_id % 10 = 9 THEN '{{"resolved":true}}'
  ELSE '{{"instance_id":"doc__' || CAST(doc_id % 250 AS STRING) || '","resolved":' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END
       || ',"resolved_status":"' || source || '","cri":"0.' || CAST(doc_id % 9 AS STRING) || '","extra":' || {js1}text{js2} || '}}' END AS value
FROM {documents}
"""),
    "b_reportfiles": (("documents",), """
SELECT doc_id, 'doc__' || CAST(doc_id AS STRING) || '.json' AS file, CASE doc_id % 6
  WHEN 0 THEN '{{"instance_id":"other","scan_failed":false,"new_violations":["B","A"],"note":' || {js1}text{js2} || '}}'
  WHEN 1 THEN '{{"new_violations":"ONE","scan_ok":true}}' WHEN 2 THEN '{{"new_violations":"","scan_failed":true,"scan_error":"e"}}'
  WHEN 3 THEN '{{"scan_ok":false}}' WHEN 4 THEN '{{broken ' || text ELSE '' END AS text
FROM {documents}
"""),
    "b_candfiles": (("documents",), """
SELECT doc_id, pos, k, 'doc__' || CAST(doc_id AS STRING) AS instance_id,
       CASE pos WHEN 0 THEN 'cand_a' WHEN 1 THEN 'cand_b' ELSE 'cand_c' END AS candidate_dir,
       CASE WHEN pos = 2 THEN '' ELSE 'diff --git a/src/m.py b/src/m.py' || chr(10) || '--- a/src/m.py' || chr(10) || '+++ b/src/m.py' || chr(10)
         || '@@ -1,1 +1,9 @@' || chr(10) || '+# ' || replace(text, chr(10), chr(10) || '+# ') || chr(10)
         || CASE k WHEN 0 THEN '+import random' WHEN 1 THEN '+token = "sk_live_' || CAST(doc_id AS STRING) || '"'
                   ELSE '+this is not ( python' END || chr(10) END AS patch
FROM (SELECT doc_id, text, 0 AS pos, doc_id % 3 AS k FROM {documents}
      UNION ALL SELECT doc_id, text, 1, (doc_id + 1) % 3 FROM {documents} WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, text, 2, 3 FROM {documents} WHERE doc_id % 5 = 0) x
"""),
    "b_evalfiles": (("documents",), """
SELECT doc_id, 'r' || d || '.json' AS file, CASE doc_id % 4
  WHEN 0 THEN '{{"report":{{"a":{{"resolved":true}},"b":{{"resolved":true,"patch_successfully_applied":false}}}},"results":[{{"instance_id":"a","resolved":false}},"junk"],"log":' || j || '}}'
  WHEN 1 THEN '[{{"task":"t' || d || '","resolved":true,"log":' || j || '}}, 5]'
  WHEN 2 THEN '{{"instance_id":"solo' || d || '","resolved":false}}' ELSE '{{"instances":[{{"id":"i' || d || '"}}],"results":{{"i' || d || '":{{"resolved":true}}}}}}' END AS text
FROM (SELECT doc_id, CAST(doc_id AS STRING) AS d, {js1}text{js2} AS j FROM {documents}) x
"""),
    "b_listing": (("documents",), """
SELECT doc_id, text, doc_id * 7919 % 1009 AS mtime, '/runs/' || CASE doc_id % 10
  WHEN 0 THEN 'trajs/doc__' || k || '.traj.json' WHEN 1 THEN 'trajectories/' || odd || 'doc__' || k || '.traj.json'
  WHEN 2 THEN 'logs/' || odd || 'doc__' || k || '.log' WHEN 3 THEN 'logs/doc__' || k || '.txt'
  WHEN 4 THEN 'eval/r' || d || '/doc__' || five || '/run_instance.log' WHEN 5 THEN 'out/m' || d || '.run' || five || '.json'
  WHEN 6 THEN 'p' || k || '/preds.json' WHEN 7 THEN odd || 'p' || k || '/preds_filled.json'
  WHEN 8 THEN 'proofcards/' || odd || 'doc__' || k || '.json' ELSE 'proofcards/doc__' || k || '.proofcard.json' END AS path
FROM (SELECT doc_id, text, CAST(doc_id AS STRING) AS d, CAST(CAST(floor(doc_id / 10) AS BIGINT) AS STRING) AS k,
             CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS five, CASE WHEN floor(doc_id / 10) % 2 = 1 THEN 'x' ELSE '' END AS odd
      FROM {documents}) x
"""),
    "b_attempts_code": (("documents",), """
SELECT 'doc__' || CAST(CAST(floor(doc_id / 5) AS BIGINT) * 2 AS STRING) AS task, doc_id % 5 AS step, 'def f' || CAST(doc_id AS STRING) || '():' || chr(10) || text AS code,
       CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 9 AS STRING) || ' failed' END AS output,
       CASE doc_id % 3 WHEN 0 THEN {empty} WHEN 1 THEN {arr}('E501') ELSE {arr}('E501', 'F401') END AS lint,
       CASE WHEN doc_id % 4 = 0 THEN {arr}('[high] x@' || source) ELSE {empty} END AS viol
FROM {documents}
"""),
    "b_trajfiles": (("conversations",), """
SELECT conv_id, 'c' || CAST(conv_id AS STRING) || '.traj.json' AS file, s, CASE conv_id % 7 WHEN 5 THEN '{{unreadable' WHEN 6 THEN '{{"info":{{}}}}'
  ELSE '{{"info":{{"submission":' || {js1}s{js2} || '}}}}' END AS text
FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'diff --git a/m.py b/m.py' || chr(10) || text || ' ' || chr(10) ELSE text END AS s,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {conversations}) x WHERE r = 1
"""),
}


def hmac_sql(dialect: dict, key: str, msg: str) -> str:
    """HMAC-SHA256 hex of ``msg`` (SQL expression) in either dialect."""
    from gavel.functions.crypto import _pads
    ipad, opad = _pads(key.encode("utf-8"))
    if dialect is SPARK:
        return (f"sha2(concat(X'{opad.hex()}', unhex(sha2(concat(X'{ipad.hex()}', encode({msg}, 'UTF-8')), 256))), 256)")
    return f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || encode({msg}))))"


def sql_for(name: str, dialect: dict, tables: dict[str, str] | None = None) -> str:
    deps, text = BRIDGES[name]
    slots = dict(dialect)
    slots["unit"] = LIMITER_UNIT
    slots["hmac_u"] = hmac_sql(dialect, DEMO_KEY, "'u' || CAST(user_id AS STRING)")
    for t in deps:
        slots[t] = (tables or {}).get(t, t)
    return text.format(**slots)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    deps, _ = BRIDGES[name]
    frames = {t: read_table(spark, sf_dir, t) for t in deps}
    # spark.sql fills {table} slots, so braces of the text itself are doubled
    text = sql_for(name, SPARK, {t: f"\0{t}\0" for t in deps}).replace("{", "{{").replace("}", "}}")
    for t in deps:
        text = text.replace(f"\0{t}\0", "{" + t + "}")
    return spark.sql(text, **frames)


def iteration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``b_iter`` and their ``run_key``, the number in the run's name.

    Rows are dealt and sorted by that number, not by the name: all names begin
    alike, so that a sort by them compares whole rows, and what follows can group
    by the number without another exchange. Only numbers pass the exchange."""
    return spark.sql("""
SELECT run_key, 'run__' || CAST(run_key AS STRING) AS run, tau_step,
       tt AS total_tests, CASE WHEN ff < tt THEN ff ELSE tt END AS tests_failed, n_violations,
       CASE WHEN n_violations = 1 THEN array('SQLI_FSTRING') ELSE CAST(array() AS ARRAY<STRING>) END AS violations, n_lint
FROM (SELECT run_key, tt, ff, n_violations, n_lint,
             CAST(row_number() OVER (PARTITION BY run_key ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS tau_step
      FROM (SELECT l_orderkey AS run_key, l_linenumber, l_partkey, l_suppkey,
                   CAST(floor(l_quantity) AS BIGINT) % 6 AS tt, CAST(floor(l_extendedprice) AS BIGINT) % 3 AS ff,
                   CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS n_violations,
                   CAST(floor(l_tax * 100.0) AS BIGINT) % 4 AS n_lint
            FROM {lineitem}) numbers) steps
""", lineitem=read_table(spark, sf_dir, "lineitem"))


def oracle_cte(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause defining the named bridges for DuckDB."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({sql_for(n, DUCK)})" for n in names)


def session_op(k: int, event: dict) -> tuple:
    """The k-th event of a chain as (op, session_id, user_id, new_session_id),
    the rule of ``b_session_log``; a chain is named by its first event."""
    kind, chain = event["event_type"], event["chain"]
    if k == 1:
        return "create", f"s{chain}_1", f"u{event['user_id']}", None
    rotates = kind in ("view", "click", "purchase")
    used = max(k - 2, 1) if kind in ("purchase", "signup") else k - 1
    return "rotate" if rotates else "invalidate", f"s{chain}_{used}", None, f"s{chain}_{k}" if rotates else None
