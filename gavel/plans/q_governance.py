"""Registered queries: governed evaluation (MET-15) and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.operators.governance import governed_eval
from gavel.plans import sqltext as Q
from gavel.plans.sqltext import q
from gavel.sources.bridges import bridge, oracle_cte
from gavel.sources.files import merge_statuses

MODEL_ID = "bridge-model"

# Scalar projection of an eval row (arrays rendered, struct dropped) so the
# Spark and DuckDB results compare value by value.
PRESENT = [
    "model", "provider", "task", "type", "source", "status", "resolved", "resolved_status", "eval_status",
    "tests_passed", "tests_failed", "total_tests", "test_pass_rate", "cri", "sad_flag", "security_scan_failed",
    "security_scan_error", "security_scan_scope", "security_report_found", "tau", "tau_max", "cri_threshold",
    "final_decision", "iterations", "patch_bytes", "patch_sha256", "violations", "infra_timeout_before_patch",
    "decision_reason", "seq",
]


def present(ev: DataFrame) -> DataFrame:
    return ev.withColumn("violations", F.array_join("security_violations", ";")).select(*PRESENT)


def governed_from_bridges(spark: SparkSession, sf: str, *, with_reports=True, allow_fallback=True,
                          artifacts: DataFrame | None = None) -> DataFrame:
    preds = bridge(spark, sf, "b_preds").drop("form")
    statuses = merge_statuses(bridge(spark, sf, "b_status_raw"), order=("file", "ts", "pos"))
    results = bridge(spark, sf, "b_results")
    reports = bridge(spark, sf, "b_reports") if with_reports else None
    return governed_eval(preds, statuses, results, reports, artifacts, model_id=MODEL_ID, allow_diff_fallback=allow_fallback)


def q_met15(spark: SparkSession, sf: str) -> DataFrame:
    return present(governed_from_bridges(spark, sf))


def q_met15_no_reports(spark: SparkSession, sf: str) -> DataFrame:
    return present(governed_from_bridges(spark, sf, with_reports=False))


def q_met15_missing_reports(spark: SparkSession, sf: str) -> DataFrame:
    return present(governed_from_bridges(spark, sf, allow_fallback=False))


# ------------------------------------------------------------------ oracle
def _oracle(with_reports: bool, allow_fallback: bool) -> str:
    norm, last = Q.normalize_ctes("b_preds", "model_patch", "instance_id, seq, provider, tau_step, form")
    ws, nonws = K.PY_WS, K.PY_NONWS
    timeout = q(K.TIMEOUT_RE)
    plus_path = f"regexp_replace(regexp_extract(line, {q('^[+][+][+]' + ws + '+(' + nonws + '+)')}, 1), '^b/', '')"
    code_ok = f"content <> '' AND NOT starts_with({Q.lstrip('content')}, '#')"
    nrm = Q.strip("content")
    snip = f"CASE WHEN length(nrm) > 160 THEN substring(nrm, 1, 157) || '...' ELSE nrm END"
    label = (f"'{K.SECRET_LABEL}' || CASE WHEN coalesce(cur_path, '') <> '' THEN '@' || cur_path || ': ' || ({snip})"
             f" ELSE ': ' || ({snip}) END")
    dummy = " OR ".join(f"contains(lower({Q.strip('val')}), {q(m)})" for m in K.SECRET_DUMMY_MARKERS)
    sev = f"CASE WHEN {Q.is_test_path('cur_path')} OR {dummy} THEN 'info' ELSE 'high' END"
    haspy = " OR ".join(f"contains(patch, {q(t)})" for t in K.PY_LIKE_TOKENS)
    sn = Q.status_norm("status")
    smap = (f"CASE WHEN {Q.in_list(sn, K.STATUS_SUCCESS)} THEN 'OK' WHEN {Q.in_list(sn, K.STATUS_ERROR)} THEN 'VETO'"
            f" ELSE 'ABSTAIN' END")
    stt = (f"CASE WHEN {Q.in_list(sn, K.STATUS_SUCCESS)} OR {Q.in_list(sn, K.STATUS_ERROR)} THEN 1"
           f" WHEN {Q.in_list(sn, K.STATUS_PENDING)} OR {Q.in_list(sn, K.STATUS_UNKNOWN)} THEN 0 ELSE 1 END")
    stp = f"CASE WHEN {Q.in_list(sn, K.STATUS_SUCCESS)} THEN 1 ELSE 0 END"
    fb = "true" if allow_fallback else "false"
    rep_join = ("LEFT JOIN b_reports rp ON rp.instance_id = p.instance_id" if with_reports else "")
    rep_cols = ("rp.instance_id IS NOT NULL AS found, rp.scan_scope AS rp_scope, rp.scan_failed AS rp_failed,"
                " rp.scan_ok AS rp_ok, rp.scan_error AS rp_error, rp.new_violations AS rp_viol,"
                " coalesce(rp.corrupt, false) AS rp_corrupt" if with_reports else
                "false AS found, NULL AS rp_scope, NULL::BOOLEAN AS rp_failed, NULL::BOOLEAN AS rp_ok,"
                " NULL AS rp_error, NULL::VARCHAR[] AS rp_viol, false AS rp_corrupt")
    need_scan = f"(NOT found AND {fb if with_reports else 'true'})"
    rep_viol = f"CASE WHEN rp_corrupt THEN CAST([] AS VARCHAR[]) ELSE list_transform(coalesce(rp_viol, CAST([] AS VARCHAR[])), lambda v: {Q.tag('v')}) END"
    names = ["b_preds", "b_results", "b_status_raw"] + (["b_reports"] if with_reports else [])
    return f"""{oracle_cte(*names)},
{norm},
st AS (SELECT instance_id, status FROM b_status_raw WHERE instance_id IS NOT NULL AND status IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY file DESC, ts DESC, pos DESC) = 1),
j AS (SELECT p.*, coalesce(s.status, 'Unknown') AS status, r.instance_id IS NOT NULL AS has_result,
             r.resolved AS r_flag, nullif(upper(coalesce(r.resolved_status, '')), '') AS rs, {rep_cols}
      FROM {last} p LEFT JOIN st s ON s.instance_id = p.instance_id
      LEFT JOIN b_results r ON r.instance_id = p.instance_id {rep_join}),
f0 AS (SELECT *, patch <> '' AND contains(lower(patch), 'docker') AND regexp_matches(patch, {timeout}) AS infra1 FROM j),
f AS (SELECT *, NOT infra1 AND patch <> '' AND regexp_matches(patch, {timeout}) AND NOT has_result AS infra2 FROM f0),
g AS (SELECT *, {need_scan} AND NOT infra1 AND NOT infra2 AS need_scan FROM f),
ln AS (SELECT seq, unnest(string_split(patch, chr(10))) AS line,
              generate_subscripts(string_split(patch, chr(10)), 1) AS pos FROM g WHERE need_scan),
lb AS (SELECT *, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY seq ORDER BY pos) AS blk FROM ln),
ls AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ ') THEN {plus_path} END IGNORE NULLS) OVER w AS cur_path,
              coalesce(bool_or(starts_with(line, '@@ ')) OVER w, false) AS in_hunk
       FROM lb WINDOW w AS (PARTITION BY seq, blk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
code AS (SELECT seq, cur_path, substring(line, 2) AS content FROM ls
         WHERE in_hunk AND starts_with(line, '+') AND NOT starts_with(line, '+++ ')),
code2 AS (SELECT seq, cur_path, content, {nrm} AS nrm FROM code WHERE {code_ok}),
hits AS (SELECT seq, cur_path, nrm, unnest(regexp_extract_all(nrm, {q(K.SECRET_RE)}, 2)) AS val FROM code2),
light AS (SELECT seq, list_sort(list_distinct(list('[' || ({sev}) || '] ' || ({label})))) AS light FROM hits GROUP BY seq),
nb AS (SELECT seq, bool_or({Q.strip('content')} <> '') AS nonblank FROM code2 GROUP BY seq),
sc AS (SELECT g.*, coalesce(light.light, CAST([] AS VARCHAR[])) AS light, {haspy} AS haspy,
              NOT coalesce(nb.nonblank, false) AS blank
       FROM g LEFT JOIN light ON light.seq = g.seq LEFT JOIN nb ON nb.seq = g.seq),
sec AS (SELECT *,
   CASE WHEN found THEN {rep_viol} WHEN need_scan THEN light ELSE CAST([] AS VARCHAR[]) END AS viol,
   CASE WHEN found THEN rp_corrupt OR ((coalesce(rp_failed, false) OR rp_ok IS NOT DISTINCT FROM false) AND len({rep_viol}) = 0)
        WHEN need_scan THEN CASE WHEN len(light) > 0 THEN false WHEN NOT haspy OR blank THEN true ELSE form = 0 END
        ELSE true END AS failed,
   CASE WHEN found THEN CASE WHEN rp_corrupt THEN {q(K.ERR_UNREADABLE)} ELSE coalesce(nullif(rp_error, ''), {q(K.ERR_MARKED)}) END
        WHEN need_scan THEN {q(K.ERR_FALLBACK)} ELSE {q(K.ERR_MISSING)} END AS err0,
   CASE WHEN found THEN CASE WHEN rp_corrupt THEN {q(K.SCOPE_POSTAPPLY)} ELSE coalesce(rp_scope, {q(K.SCOPE_POSTAPPLY)}) END
        WHEN {fb if with_reports else 'true'} THEN {q(K.SCOPE_FALLBACK)} ELSE {q(K.SCOPE_MISSING)} END AS scope,
   CAST({stp} AS BIGINT) AS tp, CAST({stt} - {stp} AS BIGINT) AS tf, CAST({stt} AS BIGINT) AS tt, {smap} AS base
  FROM sc),
m AS (SELECT *, len(list_filter(viol, lambda z: {Q.severity_of('z')} = 'high')) > 0 AS sad,
             {Q.cri_v2('tp', 'tt', 'viol', 'failed')} AS cri0,
             CASE WHEN has_result THEN coalesce(r_flag, CASE WHEN rs = 'RESOLVED' THEN true
                  WHEN rs IN ('UNRESOLVED', 'PATCH_APPLY_FAILED') THEN false END) END AS res
      FROM sec),
m2 AS (SELECT *, CASE WHEN has_result THEN CASE WHEN res IS NOT DISTINCT FROM true THEN 'resolved'
                  WHEN rs = 'UNRESOLVED' THEN 'unresolved' WHEN rs = 'PATCH_APPLY_FAILED' THEN 'error' END END AS ev,
              CASE WHEN sad THEN 'VETO' WHEN failed THEN 'ABSTAIN'
                   WHEN base = 'OK' AND tt > 0 AND cri0 >= 0.9::DOUBLE THEN 'OK' ELSE 'ABSTAIN' END AS dec0
       FROM m),
m3 AS (SELECT *, has_result AND ev IS NOT NULL AS merged,
              CAST(CASE WHEN coalesce(res, false) THEN 1 ELSE 0 END AS BIGINT) AS mtp,
              {Q.cri_v2('CASE WHEN coalesce(res, false) THEN 1 ELSE 0 END', '1', 'viol', 'failed',
                        "CASE ev WHEN 'error' THEN 0.25::DOUBLE WHEN 'infra_error' THEN 0.5::DOUBLE WHEN 'infra_failure' THEN 0.5::DOUBLE WHEN 'infra_timeout_before_patch' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")} AS mcri
       FROM m2),
o AS (SELECT {q(MODEL_ID)} AS model, provider, instance_id AS task, {q(K.ROW_TYPE)} AS type, {q(K.ROW_SOURCE)} AS source, status,
   CASE WHEN infra1 OR infra2 THEN false WHEN has_result THEN res END AS resolved,
   CASE WHEN infra1 OR infra2 THEN {q(K.INFRA_TIMEOUT_LABEL)} WHEN has_result THEN rs END AS resolved_status,
   CASE WHEN infra1 THEN 'infra_error' WHEN infra2 THEN 'infra_timeout_before_patch' WHEN has_result THEN ev END AS eval_status,
   CAST(CASE WHEN infra1 OR infra2 THEN 0 WHEN merged THEN mtp ELSE tp END AS BIGINT) AS tests_passed,
   CAST(CASE WHEN infra1 OR infra2 THEN 0 WHEN merged THEN 1 - mtp ELSE tf END AS BIGINT) AS tests_failed,
   CAST(CASE WHEN infra1 OR infra2 THEN 0 WHEN merged THEN 1 ELSE tt END AS BIGINT) AS total_tests,
   CASE WHEN infra1 OR infra2 THEN 0.0::DOUBLE WHEN merged THEN CAST(mtp AS DOUBLE)
        WHEN tt > 0 THEN CAST(tp AS DOUBLE) / CAST(tt AS DOUBLE) ELSE 0.0::DOUBLE END AS test_pass_rate,
   CASE WHEN infra1 OR infra2 THEN 0.0::DOUBLE WHEN merged THEN mcri ELSE cri0 END AS cri,
   CASE WHEN infra1 OR infra2 THEN false ELSE sad END AS sad_flag,
   CASE WHEN infra1 OR infra2 THEN false ELSE failed END AS security_scan_failed,
   CASE WHEN infra1 OR infra2 THEN NULL WHEN failed THEN err0 END AS security_scan_error,
   CASE WHEN infra1 OR infra2 THEN {q(K.SCOPE_INFRA_SKIP)} ELSE scope END AS security_scan_scope,
   CASE WHEN infra1 OR infra2 THEN false ELSE found END AS security_report_found,
   CAST(tau_step AS BIGINT) AS tau, CAST(3 AS BIGINT) AS tau_max, 0.9::DOUBLE AS cri_threshold,
   CASE WHEN infra1 OR infra2 THEN 'ABSTAIN' WHEN merged THEN
        CASE WHEN sad THEN 'VETO' WHEN failed THEN 'ABSTAIN' WHEN coalesce(res, false) AND mcri >= 0.9::DOUBLE THEN 'OK'
             ELSE 'ABSTAIN' END
        ELSE dec0 END AS final_decision,
   CAST(tau_step AS BIGINT) AS iterations, CAST(strlen(patch) AS BIGINT) AS patch_bytes, sha256(patch) AS patch_sha256,
   CASE WHEN infra1 OR infra2 THEN '' ELSE array_to_string(viol, ';') END AS violations,
   infra1 OR infra2 AS infra_timeout_before_patch, seq
  FROM m3)
SELECT * EXCLUDE (seq), seq,
  CASE WHEN sad_flag THEN 'sad_veto' WHEN security_scan_failed THEN 'security_scan_failed'
       WHEN final_decision = 'OK' THEN 'ok' WHEN resolved IS DISTINCT FROM true THEN 'not_resolved'
       WHEN cri < 0.9::DOUBLE THEN 'cri_below_threshold' ELSE 'abstain' END AS decision_reason
FROM o"""


ORACLE = {
    "met15_governed_eval": _oracle(True, True),
    "met15_governed_eval_no_reports": _oracle(False, True),
    "met11_missing_report": _oracle(True, False),
}

QUERIES = {
    "met15_governed_eval": q_met15,
    "met15_governed_eval_no_reports": q_met15_no_reports,
    "met11_missing_report": q_met15_missing_reports,
}
