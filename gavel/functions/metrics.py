"""Reliability scores and decisions as Column expressions (MET-1..14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.text import _c, py_strip, violation_severity

def empty_arr() -> Column:
    return F.array().cast("array<string>")


def clip01(x: Column) -> Column:
    return F.when(x < 0.0, F.lit(0.0)).when(x > 1.0, F.lit(1.0)).otherwise(x)


def high_count(violations) -> Column:
    v = F.coalesce(_c(violations), empty_arr())
    return F.size(F.filter(v, lambda x: violation_severity(x) == "high"))


def any_high(violations) -> Column:
    """AGG-9 / SAD: any high-severity finding."""
    v = F.coalesce(_c(violations), empty_arr())
    return F.exists(v, lambda x: violation_severity(x) == "high")


def infra_penalty(eval_status) -> Column:
    e = _c(eval_status)
    out = F.lit(0.0)
    for status, pen in sorted(K.INFRA_PENALTY.items(), key=lambda kv: kv[0]):
        out = F.when(e == status, F.lit(float(pen))).otherwise(out)
    return out


def cri_v2(tests_passed, total_tests, violations, scan_failed, eval_status=None) -> Column:
    """MET-3: clip01(rate * (1 - infra) - 0.4*high - 0.05*info - 0.25*[failed, no findings])."""
    tp, tt = _c(tests_passed).cast("double"), _c(total_tests)
    v = F.coalesce(_c(violations), empty_arr())
    rate = F.when(tt > 0, clip01(tp / tt.cast("double"))).otherwise(F.lit(0.0))
    high = high_count(v)
    info = F.size(v) - high
    pen = (F.lit(K.PENALTY_HIGH) * high + F.lit(K.PENALTY_INFO) * info
           + F.when(F.coalesce(_c(scan_failed), F.lit(False)) & (F.size(v) == 0), F.lit(K.PENALTY_SCAN_FAILED))
           .otherwise(F.lit(0.0)))
    infra = F.lit(0.0) if eval_status is None else infra_penalty(eval_status)
    return clip01(rate * (F.lit(1.0) - infra) - pen)


def status_metrics(status, evaluator_resolved=None) -> Column:
    """MET-4: exit status (or an evaluator verdict) -> struct(tests_passed,
    tests_failed, total_tests, base_decision)."""
    s = F.lower(py_strip(F.coalesce(_c(status), F.lit(""))))

    def row(p, f, t, d):
        return F.struct(F.lit(p).cast("bigint").alias("tests_passed"), F.lit(f).cast("bigint").alias("tests_failed"),
                        F.lit(t).cast("bigint").alias("total_tests"), F.lit(d).alias("base_decision"))

    out = (F.when(s.isin(*K.STATUS_SUCCESS), row(1, 0, 1, "OK"))
           .when(s.isin(*K.STATUS_ERROR), row(0, 1, 1, "VETO"))
           .when(s.isin(*K.STATUS_PENDING), row(0, 0, 0, "ABSTAIN"))
           .when(s.isin(*K.STATUS_UNKNOWN), row(0, 0, 0, "ABSTAIN"))
           .otherwise(row(0, 1, 1, "ABSTAIN")))
    if evaluator_resolved is not None:
        ev = _c(evaluator_resolved)
        out = F.when(ev.isNull(), out).when(ev, row(1, 0, 1, "OK")).otherwise(row(0, 1, 1, "ABSTAIN"))
    return out


def normalize_resolved(resolved_status, resolved_flag) -> Column:
    """MET-5: a non-blank status string beats the bool flag."""
    s = F.lower(py_strip(_c(resolved_status)))
    flag = _c(resolved_flag)
    return (F.when(s.isNotNull() & (s != ""),
                   F.when(s.isin("resolved", "pass", "passed"), F.lit("resolved")).otherwise(F.lit("unresolved")))
            .when(flag.isNotNull(), F.when(flag, F.lit("resolved")).otherwise(F.lit("unresolved"))))


def report_outcome(resolved, patch_applied) -> Column:
    """MET-6: evaluator report entry -> resolved_status."""
    r = F.coalesce(_c(resolved), F.lit(False))
    return (F.when(_c(patch_applied).eqNullSafe(F.lit(False)), F.lit("PATCH_APPLY_FAILED"))
            .when(r, F.lit("RESOLVED")).otherwise(F.lit("UNRESOLVED")))


def base_decision(sad, scan_failed, base, total_tests, cri, threshold=K.CRI_THRESHOLD) -> Column:
    """MET-7: high severity vetoes, a failed scan abstains, a base OK needs
    tests and cri >= threshold; everything else (base VETO too) abstains."""
    return (F.when(_c(sad), F.lit("VETO"))
            .when(_c(scan_failed), F.lit("ABSTAIN"))
            .when((_c(base) == "OK") & (_c(total_tests) > 0) & (_c(cri) >= F.lit(float(threshold))), F.lit("OK"))
            .otherwise(F.lit("ABSTAIN")))


def merged_resolved(resolved_flag, resolved_status_upper) -> Column:
    """MET-8: a bool flag wins, else the status string decides."""
    rs = _c(resolved_status_upper)
    return F.coalesce(_c(resolved_flag),
                      F.when(rs == "RESOLVED", F.lit(True))
                      .when(rs.isin("UNRESOLVED", "PATCH_APPLY_FAILED"), F.lit(False)))


def merged_eval_status(resolved, resolved_status_upper) -> Column:
    rs = _c(resolved_status_upper)
    return (F.when(_c(resolved).eqNullSafe(F.lit(True)), F.lit("resolved"))
            .when(rs == "UNRESOLVED", F.lit("unresolved"))
            .when(rs == "PATCH_APPLY_FAILED", F.lit("error")))


def decision_reason(final_decision, sad, scan_failed, resolved, cri, threshold=K.CRI_THRESHOLD) -> Column:
    """MET-10: first matching reason."""
    return (F.when(F.coalesce(_c(sad), F.lit(False)), F.lit(K.REASON_SAD))
            .when(F.coalesce(_c(scan_failed), F.lit(False)), F.lit(K.REASON_SCAN_FAILED))
            .when(_c(final_decision) == "OK", F.lit(K.REASON_OK))
            .when(~(_c(resolved).eqNullSafe(F.lit(True))), F.lit(K.REASON_NOT_RESOLVED))
            .when(F.coalesce(_c(cri), F.lit(0.0)) < F.lit(float(threshold)), F.lit(K.REASON_BELOW))
            .otherwise(F.lit(K.REASON_ABSTAIN)))


# ----------------------------------------------------------- task loop (v1)
def cri_v1(total_tests, tests_failed, n_violations, n_lint) -> Column:
    """MET-1: clip01(pass_rate - 0.1*violations - 0.02*lint); 0 tests -> rate 0."""
    tt, tf = _c(total_tests), _c(tests_failed)
    rate = F.when(tt > 0, (tt - tf).cast("double") / tt.cast("double")).otherwise(F.lit(0.0))
    return clip01(rate - F.lit(K.V1_PENALTY_VIOLATION) * _c(n_violations)
                  - F.lit(K.V1_PENALTY_LINT) * _c(n_lint))


def decide_v1(sad, cri, tests_failed, threshold=K.CRI_THRESHOLD) -> Column:
    """MET-2: SAD vetoes; cri >= t with no failed test is OK; else ABSTAIN."""
    return (F.when(_c(sad), F.lit("VETO"))
            .when((_c(cri) >= F.lit(float(threshold))) & (_c(tests_failed) == 0), F.lit("OK"))
            .otherwise(F.lit("ABSTAIN")))


# ------------------------------------------------------- candidates (MET-12/13)
def candidate_decision(sad, scan_failed, resolved) -> Column:
    """MET-12: any finding vetoes, failed scan abstains, resolved is OK."""
    return (F.when(_c(sad), F.lit("VETO")).when(_c(scan_failed), F.lit("ABSTAIN"))
            .when(_c(resolved), F.lit("OK")).otherwise(F.lit("ABSTAIN")))


def candidate_tier(final_decision, resolved) -> Column:
    """MET-13: VETO 3, resolved+OK 0, resolved 1, else 2."""
    r = F.coalesce(_c(resolved), F.lit(False))
    return (F.when(_c(final_decision) == "VETO", F.lit(3))
            .when(r & (_c(final_decision) == "OK"), F.lit(0))
            .when(r, F.lit(1)).otherwise(F.lit(2)))
