"""MET-15: the governed evaluation as one DataFrame plan.

predictions --normalise/fingerprint (map side)--> left join statuses
--> left join instance results --> left join security reports
--> security scan only where a report is absent (guarded, Python parse
check only on the rows that need it) --> status map, CRI, base decision
--> outcome merge --> decision reason.

All joins use the same key, so after the first exchange the predictions
side keeps its hash partitioning and later sort-merge joins only shuffle
the right sides; AQE turns any right side that is small at runtime into a
broadcast (a measured, not assumed, size bound) and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions import metrics as M
from gavel.functions import security as S
from gavel.functions import text as X
from gavel.operators.pycheck import python_scan_ok

EVAL_COLUMNS = [
    "model", "provider", "task", "type", "source", "status", "resolved", "resolved_status", "eval_status",
    "tests_passed", "tests_failed", "total_tests", "test_pass_rate", "cri", "sad_flag", "security_scan_failed",
    "security_scan_error", "security_scan_scope", "security_report_found", "tau", "tau_max", "cri_threshold",
    "final_decision", "iterations", "patch", "patch_bytes", "patch_sha256", "security_violations",
    "infra_timeout_before_patch", "artifacts", "decision_reason",
]


def prepare_predictions(preds: DataFrame) -> DataFrame:
    """Normalise and fingerprint patches; cheap per-row work before joins."""
    cols = set(preds.columns)
    provider = F.col("provider") if "provider" in cols else F.lit(None).cast("string")
    tau = F.col("tau_step") if "tau_step" in cols else F.lit(None).cast("bigint")
    if "seq" in cols:
        seq = F.col("seq")
    elif preds.isStreaming:  # arrival order is not a row property of a stream
        seq = F.lit(None).cast("bigint")
    else:
        seq = F.monotonically_increasing_id()
    p = preds.select(F.col("instance_id").cast("string").alias("instance_id"), seq.alias("seq"),
                     F.coalesce(provider, F.lit(K.DEFAULT_PROVIDER)).alias("provider"),
                     F.coalesce(tau.cast("bigint"), F.lit(1).cast("bigint")).alias("tau"),
                     F.col("model_patch"))
    p = X.with_normalized_patch(p, "model_patch", "patch").drop("model_patch")
    return (p.withColumn("patch_bytes", X.patch_bytes("patch"))
            .withColumn("patch_sha256", X.patch_sha256("patch")))


def governed_eval(preds: DataFrame, statuses: DataFrame | None = None, results: DataFrame | None = None,
                  reports: DataFrame | None = None, artifacts: DataFrame | None = None, *, model_id: str,
                  allow_diff_fallback: bool = False, tau_max: int = K.TAU_MAX,
                  cri_threshold: float = K.CRI_THRESHOLD, prepared: bool = False) -> DataFrame:
    """Eval rows, one per prediction (duplicates kept), with ``seq`` carried.

    statuses : (instance_id, status) unique per id (see sources.merge_statuses)
    results  : (instance_id, resolved, resolved_status) unique per id
    reports  : (instance_id, scan_scope, scan_failed, scan_ok, scan_error,
               new_violations, corrupt) unique per id; ``None`` means no
               report directory, so every row is scanned from its diff
    artifacts: (instance_id, traj, log, proofcard)
    """
    p = preds if prepared else prepare_predictions(preds)
    t = float(cri_threshold)

    # ---- whatever reads the patch text comes before the joins, so that the
    # text itself only moves when the caller selects it ----
    p = p.withColumns({"_infra1": X.infra_timeout_docker("patch"), "_phrase": X.infra_timeout_phrase("patch")})
    if reports is None or allow_diff_fallback:
        p = p.withColumn("_scan_src", F.when(~F.col("_infra1"), F.col("patch")))
        p = p.withColumn("_ds", X.memo_column(("diff_scan", "_scan_src"), lambda: S.diff_scan(F.col("_scan_src"))))
        p = p.withColumns({"_light": F.col("_ds.light"), "_haspy": F.col("_ds.haspy"), "_blank": F.col("_ds.blank"),
                           "_parse_ok": python_scan_ok(F.col("_ds.parse_in"))}).drop("_scan_src", "_ds")
    else:  # the scan is never used
        p = p.withColumns({"_light": M.empty_arr(), "_haspy": F.lit(False), "_blank": F.lit(True), "_parse_ok": F.lit(False)})

    if statuses is not None:
        p = p.join(statuses.select("instance_id", F.col("status").alias("_status")), "instance_id", "left")
    else:
        p = p.withColumn("_status", F.lit(None).cast("string"))
    if results is not None:
        p = p.join(results.select("instance_id", F.lit(True).alias("_has_result"),
                                  F.col("resolved").alias("_r_flag"),
                                  F.col("resolved_status").alias("_r_status")), "instance_id", "left")
    else:
        p = (p.withColumn("_has_result", F.lit(None).cast("boolean"))
             .withColumn("_r_flag", F.lit(None).cast("boolean"))
             .withColumn("_r_status", F.lit(None).cast("string")))
    if reports is not None:
        p = p.join(reports.select("instance_id", F.lit(True).alias("_rep"),
                                  F.col("scan_scope").alias("_rep_scope"), F.col("scan_failed").alias("_rep_failed"),
                                  F.col("scan_ok").alias("_rep_ok"), F.col("scan_error").alias("_rep_error"),
                                  F.col("new_violations").alias("_rep_viol"), F.col("corrupt").alias("_rep_corrupt")),
                   "instance_id", "left")
    if artifacts is not None:
        p = p.join(artifacts.select("instance_id", F.struct("traj", "log", "proofcard").alias("artifacts")),
                   "instance_id", "left")
    else:
        p = p.withColumn("artifacts", F.struct(F.lit(None).cast("string").alias("traj"),
                                               F.lit(None).cast("string").alias("log"),
                                               F.lit(None).cast("string").alias("proofcard")))

    has_result = F.coalesce(F.col("_has_result"), F.lit(False))
    infra2 = ~F.col("_infra1") & F.col("_phrase") & ~has_result
    p = p.withColumns({"_infra2": infra2, "status": F.coalesce(F.col("_status"), F.lit(K.DEFAULT_STATUS))})

    # ---- security: report, else diff-fragment scan (only where needed) ----
    if reports is not None:
        found = F.coalesce(F.col("_rep"), F.lit(False))
        corrupt = F.coalesce(F.col("_rep_corrupt"), F.lit(False))
        need_scan = ~found & F.lit(bool(allow_diff_fallback))
    else:
        found = F.lit(False)
        need_scan = F.lit(True)
    need_scan = need_scan & ~F.col("_infra1") & ~F.col("_infra2")
    p = p.withColumns({"_found": found, "_need_scan": need_scan})
    p = p.withColumn("_light", F.when(F.col("_need_scan"), F.col("_light")))
    scan_failed = S.diff_scan_failed(F.lit(False), F.col("_light"), F.col("_haspy"), F.col("_blank"),
                                     F.col("_parse_ok"))

    if reports is not None:
        rep_viol = F.when(corrupt, M.empty_arr()).otherwise(
            F.transform(F.coalesce(F.col("_rep_viol"), M.empty_arr()), lambda v: X.tag_violation(v)))
        rep_failed = corrupt | ((F.coalesce(F.col("_rep_failed"), F.lit(False)) | (F.col("_rep_ok").eqNullSafe(F.lit(False))))
                                & (F.size(rep_viol) == 0))
        rep_error = F.when(corrupt, F.lit(K.ERR_UNREADABLE)).otherwise(
            F.coalesce(F.nullif(F.col("_rep_error"), F.lit("")), F.lit(K.ERR_MARKED)))
        rep_scope = F.when(corrupt, F.lit(K.SCOPE_POSTAPPLY)).otherwise(
            F.coalesce(F.col("_rep_scope"), F.lit(K.SCOPE_POSTAPPLY)))
        viol = F.when(found, rep_viol).when(need_scan, F.col("_light")).otherwise(M.empty_arr())
        failed = F.when(found, rep_failed).when(need_scan, scan_failed).otherwise(F.lit(True))
        error = (F.when(found, rep_error).when(need_scan, F.lit(K.ERR_FALLBACK))
                 .otherwise(F.lit(K.ERR_MISSING)))
        scope = (F.when(found, rep_scope).when(F.lit(bool(allow_diff_fallback)), F.lit(K.SCOPE_FALLBACK))
                 .otherwise(F.lit(K.SCOPE_MISSING)))
    else:
        viol = F.coalesce(F.col("_light"), M.empty_arr())
        failed = scan_failed
        error = F.lit(K.ERR_FALLBACK)
        scope = F.lit(K.SCOPE_FALLBACK)
    p = p.withColumns({"_viol": viol, "_failed": failed, "_error_if": error, "_scope": scope})

    # ---- base metrics and decision ----
    sm = X.memo_column(("status_metrics", "status"), lambda: M.status_metrics("status"))
    rs_up = F.nullif(F.upper(F.coalesce(F.col("_r_status"), F.lit(""))), F.lit(""))
    p = p.withColumns({"_sm": sm, "_rs": rs_up, "_error": F.when(F.col("_failed"), F.col("_error_if"))})
    tp, tf, tt = F.col("_sm.tests_passed"), F.col("_sm.tests_failed"), F.col("_sm.total_tests")
    sad = X.memo_column(("any_high", "_viol"), lambda: M.any_high("_viol"))
    cri0 = X.memo_column(("cri0",), lambda: M.cri_v2(F.col("_sm.tests_passed"), F.col("_sm.total_tests"),
                                                    F.col("_viol"), F.col("_failed")))
    res = M.merged_resolved(F.col("_r_flag"), F.col("_rs"))
    p = p.withColumns({"_sad": sad, "_cri0": cri0, "_res": F.when(has_result, res)})
    dec0 = M.base_decision(F.col("_sad"), F.col("_failed"), F.col("_sm.base_decision"), tt, F.col("_cri0"), t)
    rate0 = F.when(tt > 0, tp.cast("double") / tt.cast("double")).otherwise(F.lit(0.0))

    # ---- outcome merge (MET-8) ----
    ev = M.merged_eval_status(F.col("_res"), F.col("_rs"))
    p = p.withColumn("_ev", F.when(has_result, ev))
    merged = has_result & F.col("_ev").isNotNull()
    r_ok = F.coalesce(F.col("_res"), F.lit(False))
    m_tp = F.when(r_ok, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    m_tf = F.when(r_ok, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    m_tt = F.lit(1).cast("bigint")
    m_cri = X.memo_column(("mcri",), lambda: M.cri_v2(
        F.when(F.coalesce(F.col("_res"), F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        F.lit(1).cast("bigint"), F.col("_viol"), F.col("_failed"), F.col("_ev")))
    p = p.withColumn("_mcri", m_cri)
    m_dec = (F.when(F.col("_sad"), F.lit("VETO")).when(F.col("_failed"), F.lit("ABSTAIN"))
             .when(r_ok & (F.col("_mcri") >= F.lit(t)), F.lit("OK")).otherwise(F.lit("ABSTAIN")))

    infra = F.col("_infra1") | F.col("_infra2")
    zero = F.lit(0).cast("bigint")
    out = p.select(
        F.lit(model_id).alias("model"), "provider", F.col("instance_id").alias("task"),
        F.lit(K.ROW_TYPE).alias("type"), F.lit(K.ROW_SOURCE).alias("source"), "status",
        F.when(infra, F.lit(False)).when(has_result, F.col("_res")).alias("resolved"),
        F.when(infra, F.lit(K.INFRA_TIMEOUT_LABEL)).when(has_result, F.col("_rs")).alias("resolved_status"),
        F.when(F.col("_infra1"), F.lit("infra_error")).when(F.col("_infra2"), F.lit("infra_timeout_before_patch"))
        .when(has_result, F.col("_ev")).alias("eval_status"),
        F.when(infra, zero).when(merged, m_tp).otherwise(tp).alias("tests_passed"),
        F.when(infra, zero).when(merged, m_tf).otherwise(tf).alias("tests_failed"),
        F.when(infra, zero).when(merged, m_tt).otherwise(tt).alias("total_tests"),
        F.when(infra, F.lit(0.0)).when(merged, m_tp.cast("double")).otherwise(rate0).alias("test_pass_rate"),
        F.when(infra, F.lit(0.0)).when(merged, F.col("_mcri")).otherwise(F.col("_cri0")).alias("cri"),
        F.when(infra, F.lit(False)).otherwise(F.col("_sad")).alias("sad_flag"),
        F.when(infra, F.lit(False)).otherwise(F.col("_failed")).alias("security_scan_failed"),
        F.when(infra, F.lit(None).cast("string")).otherwise(F.col("_error")).alias("security_scan_error"),
        F.when(infra, F.lit(K.SCOPE_INFRA_SKIP)).otherwise(F.col("_scope")).alias("security_scan_scope"),
        F.when(infra, F.lit(False)).otherwise(F.col("_found")).alias("security_report_found"),
        F.col("tau"), F.lit(tau_max).cast("bigint").alias("tau_max"), F.lit(t).alias("cri_threshold"),
        F.when(infra, F.lit("ABSTAIN")).when(merged, m_dec).otherwise(dec0).alias("final_decision"),
        F.col("tau").alias("iterations"), "patch", "patch_bytes", "patch_sha256",
        F.when(infra, M.empty_arr()).otherwise(F.col("_viol")).alias("security_violations"),
        infra.alias("infra_timeout_before_patch"), "artifacts", "seq",
    )
    reason = X.memo_column(("decision_reason", t), lambda: M.decision_reason(
        "final_decision", "sad_flag", "security_scan_failed", "resolved", "cri", t))
    return out.withColumn("decision_reason", reason)


def ok_rate(evals: DataFrame) -> DataFrame:
    """AGG-1: total rows, OK rows and their share."""
    return evals.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                     F.count_if(F.col("final_decision") == "OK").cast("bigint").alias("ok"),
                     ).withColumn("ok_rate", F.when(F.col("total") > 0, F.col("ok") / F.col("total"))
                                  .otherwise(F.lit(0.0)))
