"""Registered queries: aggregates, ordered operators and per-step metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.operators import aggregates as A
from gavel.operators import ordered as O
from gavel.plans import sqltext as Q
from gavel.sources.bridges import bridge, iteration_rows, oracle_cte
from gavel.sources.files import merge_statuses

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, oracle=None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def fmt6(col):
    """Render a double array for value comparison across engines."""
    return F.array_join(F.transform(col, lambda x: F.format_string("%.6f", x)), ",")


# ------------------------------------------------------------------ AGG-1
@register("agg01_ok_rate", oracle_cte("b_eval") + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE final_decision = 'OK') AS BIGINT) AS ok,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE final_decision = 'OK') AS DOUBLE) / count(*)
            ELSE 0.0 END AS ok_rate
FROM b_eval""")
def agg01(spark, sf):
    from gavel.operators.governance import ok_rate
    return ok_rate(bridge(spark, sf, "b_eval"))


# ------------------------------------------------------------------ AGG-2
@register("agg02_frequency_tables", oracle_cte("b_eval") + """,
e AS (SELECT coalesce(final_decision, 'None') AS final_decision, coalesce(resolved_status, 'None') AS resolved_status,
             CASE WHEN coalesce(security_scan_failed, false) THEN 'true' ELSE 'false' END AS security_scan_failed,
             nullif(security_scan_scope, '') AS security_scan_scope, seq FROM b_eval)
SELECT 'final_decision' AS field, final_decision AS value, CAST(count(*) AS BIGINT) AS count, min(seq) AS first_seq FROM e GROUP BY 2
UNION ALL SELECT 'resolved_status', resolved_status, count(*), min(seq) FROM e GROUP BY 2
UNION ALL SELECT 'security_scan_failed', security_scan_failed, count(*), min(seq) FROM e GROUP BY 2
UNION ALL SELECT 'security_scan_scope', security_scan_scope, count(*), min(seq) FROM e WHERE security_scan_scope IS NOT NULL GROUP BY 2""")
def agg02(spark, sf):
    return A.frequency_tables(bridge(spark, sf, "b_eval"))


@register("win09_most_common", ORACLE["agg02_frequency_tables"].replace("SELECT 'final_decision' AS field", """SELECT field, value, count,
       row_number() OVER (PARTITION BY field ORDER BY count DESC, first_seq) AS place FROM (SELECT 'final_decision' AS field""", 1) + ") c")
def win09(spark, sf):
    """WIN-9: counts descending, ties in order of first appearance."""
    w = Window.partitionBy("field").orderBy(F.desc("count"), "first_seq")
    return A.frequency_tables(bridge(spark, sf, "b_eval")).select(
        "field", "value", "count", F.row_number().over(w).cast("bigint").alias("place"))


# ------------------------------------------------------------------ AGG-3
@register("agg03_ci_gate", oracle_cte("b_eval") + """,
d AS (SELECT upper(coalesce(nullif(final_decision, ''), 'ABSTAIN')) AS d FROM b_eval)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE d = 'OK') AS BIGINT) AS ok,
       CAST(count(*) FILTER (WHERE d NOT IN ('OK', 'VETO')) AS BIGINT) AS abstain,
       CAST(count(*) FILTER (WHERE d = 'VETO') AS BIGINT) AS veto,
       count(*) FILTER (WHERE d = 'VETO') = 0 AS passed
FROM d""")
def agg03(spark, sf):
    return A.ci_gate(bridge(spark, sf, "b_eval"))


# ------------------------------------------------------------------ AGG-4
_THR = ", ".join(f"({t}::DOUBLE)" for t in K.SWEEP_THRESHOLDS)


@register("agg04_risk_coverage", oracle_cte("b_eval") + f""",
t(threshold) AS (VALUES {_THR}),
x AS (SELECT t.threshold, e.*,
             e.final_decision = 'OK' AND NOT coalesce(e.sad_flag, false) AND NOT coalesce(e.security_scan_failed, false)
             AND coalesce(e.cri, 0.0) >= t.threshold AS acc
      FROM b_eval e CROSS JOIN t),
g AS (SELECT threshold, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE acc) AS BIGINT) AS accepted,
             CAST(count(*) FILTER (WHERE acc AND resolved = false) AS BIGINT) AS false_accepts,
             CAST(count(*) FILTER (WHERE acc AND resolved = true) AS BIGINT) AS resolved_ok,
             CAST(count(*) FILTER (WHERE final_decision = 'VETO') AS BIGINT) AS veto,
             CAST(count(*) FILTER (WHERE final_decision = 'ABSTAIN') AS BIGINT) AS abstain
      FROM x GROUP BY threshold)
SELECT threshold, total, accepted,
       CASE WHEN total > 0 THEN CAST(accepted AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS coverage,
       false_accepts,
       CASE WHEN accepted > 0 THEN CAST(false_accepts AS DOUBLE) / CAST(accepted AS DOUBLE) ELSE 0.0 END AS risk,
       resolved_ok, veto, abstain
FROM g""")
def agg04(spark, sf):
    return A.risk_coverage(bridge(spark, sf, "b_eval"))


# ------------------------------------------------------------------ AGG-5..7
@register("agg05_model_summary", oracle_cte("b_loop") + """,
last AS (SELECT * FROM b_loop QUALIFY row_number() OVER (PARTITION BY model, task, type ORDER BY seq DESC) = 1)
SELECT model, CAST(count(DISTINCT task) AS BIGINT) AS tasks,
       CAST(count(*) FILTER (WHERE type = 'baseline' AND coalesce(total_tests, 0) <> 0 AND tests_passed = total_tests) AS BIGINT)
         AS baseline_full_pass,
       CAST(count(*) FILTER (WHERE type = 'wrapped' AND final_decision = 'OK') AS BIGINT) AS wrapped_ok,
       CAST(count(*) FILTER (WHERE type = 'wrapped' AND final_decision = 'ABSTAIN') AS BIGINT) AS wrapped_abstain,
       CAST(count(*) FILTER (WHERE type = 'wrapped' AND final_decision = 'VETO') AS BIGINT) AS wrapped_veto
FROM last GROUP BY model""")
def agg05(spark, sf):
    return A.model_summary(bridge(spark, sf, "b_loop"))


@register("agg06_model_task_first", oracle_cte("b_loop") + """
SELECT model, task,
       arg_min_null(test_pass_rate, seq) FILTER (WHERE type = 'baseline') AS baseline_pass_rate,
       arg_min_null(security_violation_count, seq) FILTER (WHERE type = 'baseline') AS baseline_security_violations,
       array_to_string(list_transform(arg_min_null(cri_history, seq) FILTER (WHERE type = 'wrapped'),
                                      lambda c: printf('%.6f', c)), ',') AS wrapped_cri_history,
       array_to_string(arg_min_null(last_security_violations, seq) FILTER (WHERE type = 'wrapped'), ';')
         AS wrapped_last_security_violations,
       arg_min_null(final_decision, seq) FILTER (WHERE type = 'wrapped') AS wrapped_final_decision,
       arg_min_null(last_test_pass_rate, seq) FILTER (WHERE type = 'wrapped') AS wrapped_last_pass_rate,
       CAST(count(*) FILTER (WHERE type = 'baseline') AS BIGINT) AS n_baseline,
       CAST(count(*) FILTER (WHERE type = 'wrapped') AS BIGINT) AS n_wrapped
FROM b_loop GROUP BY model, task""")
def agg06(spark, sf):
    c = A.model_task_comparison(bridge(spark, sf, "b_loop"))
    return c.withColumn("wrapped_cri_history", fmt6(F.col("wrapped_cri_history"))).withColumn(
        "wrapped_last_security_violations", F.array_join("wrapped_last_security_violations", ";"))


@register("agg07_run_summary", oracle_cte("b_loop") + """,
s AS (SELECT CAST(count(*) FILTER (WHERE type = 'baseline') AS BIGINT) AS tasks,
             CAST(count(*) FILTER (WHERE type = 'baseline' AND test_pass_rate = 1.0) AS BIGINT) AS baseline_pass,
             CAST(count(*) FILTER (WHERE type = 'wrapped' AND last_test_pass_rate = 1.0) AS BIGINT) AS wrapped_pass
      FROM b_loop)
SELECT *, CASE WHEN tasks > 0 THEN baseline_pass * 100.0::DOUBLE / tasks END AS baseline_pct,
       CASE WHEN tasks > 0 THEN wrapped_pass * 100.0::DOUBLE / tasks END AS wrapped_pct,
       CASE WHEN tasks > 0 THEN CAST(wrapped_pass - baseline_pass AS DOUBLE) / tasks * 100.0::DOUBLE END AS improvement_pts
FROM s""")
def agg07(spark, sf):
    return A.run_summary(bridge(spark, sf, "b_loop"))


# ------------------------------------------------------------------ AGG-9
@register("agg09_violation_counts", oracle_cte("b_reports") + f""",
v AS (SELECT instance_id AS task, coalesce(new_violations, CAST([] AS VARCHAR[])) AS v FROM b_reports)
SELECT task, CAST(len(list_filter(v, lambda z: {Q.severity_of('z')} = 'high')) AS BIGINT) AS high,
       CAST(len(v) - len(list_filter(v, lambda z: {Q.severity_of('z')} = 'high')) AS BIGINT) AS info,
       len(list_filter(v, lambda z: {Q.severity_of('z')} = 'high')) > 0 AS any_high
FROM v""")
def agg09(spark, sf):
    r = bridge(spark, sf, "b_reports").select(F.col("instance_id").alias("task"),
                                               F.col("new_violations").alias("security_violations"))
    return A.violation_counts(r)


# ------------------------------------------------------------------ AGG-11, 12, 14
@register("agg11_snapshot", oracle_cte("b_eval") + """,
s AS (SELECT CAST(count(*) AS BIGINT) AS total,
             CAST(count(*) FILTER (WHERE coalesce(infra_timeout_before_patch, false)) AS BIGINT) AS infra,
             CAST(count(*) FILTER (WHERE resolved = true) AS BIGINT) AS resolved,
             CAST(count(*) FILTER (WHERE resolved = false) AS BIGINT) AS unresolved,
             CAST(count(*) FILTER (WHERE final_decision = 'OK') AS BIGINT) AS ok,
             CAST(count(*) FILTER (WHERE final_decision = 'ABSTAIN') AS BIGINT) AS abstain,
             CAST(count(*) FILTER (WHERE final_decision = 'VETO') AS BIGINT) AS veto,
             CAST(count(*) FILTER (WHERE final_decision = 'OK' AND resolved = true) AS BIGINT) AS ok_resolved
      FROM b_eval)
SELECT *, CASE WHEN total - infra > 0 THEN CAST(ok AS DOUBLE) / CAST(total - infra AS DOUBLE) ELSE 0.0 END AS coverage,
       CASE WHEN ok > 0 THEN CAST(ok_resolved AS DOUBLE) / CAST(ok AS DOUBLE) ELSE 0.0 END AS accuracy
FROM s""")
def agg11(spark, sf):
    return A.snapshot(bridge(spark, sf, "b_eval"))


_AGG12_FIELDS = ("final_decision", "resolved_status", "eval_status", "security_scan_scope", "model")


@register("agg12_multi_key_counts", oracle_cte("b_eval") + ",\nk AS (" + " UNION ALL ".join(
    f"SELECT '{f}:' || coalesce(CAST({f} AS VARCHAR), 'None') AS key FROM b_eval" for f in _AGG12_FIELDS)
    + ")\nSELECT key, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY key")
def agg12(spark, sf):
    return A.multi_key_counts(bridge(spark, sf, "b_eval"), _AGG12_FIELDS)


@register("agg14_confusion", oracle_cte("b_eval") + """
SELECT coalesce(final_decision, 'None') AS final_decision,
       CASE WHEN resolved IS NULL THEN 'None' WHEN resolved THEN 'true' ELSE 'false' END AS resolved,
       CAST(count(*) AS BIGINT) AS n
FROM b_eval GROUP BY 1, 2""")
def agg14(spark, sf):
    return A.confusion(bridge(spark, sf, "b_eval"))


# ------------------------------------------------------------------ WIN-1 / MET-12,13
_CAND_EVAL = """
ev AS (SELECT *, len(coalesce(security_violations, CAST([] AS VARCHAR[]))) > 0 AS sad_flag,
              coalesce(resolved, false) AS res, coalesce(TRY_CAST(cri AS DOUBLE), 0.0) AS cri2,
              coalesce(security_scan_failed, false) AS failed FROM b_cands),
ev2 AS (SELECT *, CASE WHEN sad_flag THEN 'VETO' WHEN failed THEN 'ABSTAIN' WHEN res THEN 'OK' ELSE 'ABSTAIN' END AS final_decision
        FROM ev),
ev3 AS (SELECT *, CASE WHEN final_decision = 'VETO' THEN 3 WHEN res AND final_decision = 'OK' THEN 0 WHEN res THEN 1 ELSE 2 END AS tier
        FROM ev2)"""


@register("met12_candidate_eval", oracle_cte("b_cands") + "," + _CAND_EVAL + """
SELECT instance_id, cand_idx, candidate_dir, res AS resolved, cri2 AS cri, sad_flag, failed AS security_scan_failed,
       final_decision, tier, changed_files, patch_size FROM ev3""")
def met12(spark, sf):
    e = O.evaluate_candidates(bridge(spark, sf, "b_cands"))
    return e.select("instance_id", "cand_idx", "candidate_dir", "resolved", "cri", "sad_flag", "security_scan_failed",
                    "final_decision", "tier", "changed_files", "patch_size")


@register("win01_best_of_k", oracle_cte("b_cands") + "," + _CAND_EVAL + """
SELECT instance_id, candidate_dir, cand_idx, tier, cri2 AS cri, final_decision, changed_files, patch_size,
       CAST(count(*) OVER (PARTITION BY instance_id) AS BIGINT) AS n_candidates
FROM ev3
QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY tier, 0.0 - cri2, changed_files, patch_size, cand_idx) = 1""")
def win01(spark, sf):
    b = O.best_of_k(bridge(spark, sf, "b_cands"))
    return b.select("instance_id", "candidate_dir", "cand_idx", "tier", "cri", "final_decision", "changed_files",
                    "patch_size", "n_candidates")


# ------------------------------------------------------------------ MET-1/2, WIN-2/3/6, MET-14
_STEPS = """
st AS (SELECT *, CASE WHEN total_tests > 0 THEN CAST(total_tests - tests_failed AS DOUBLE) / CAST(total_tests AS DOUBLE)
                      ELSE 0.0 END - 0.1::DOUBLE * n_violations - 0.02::DOUBLE * n_lint AS raw
       FROM b_iter WHERE tau_step <= 3),
st2 AS (SELECT *, CASE WHEN raw < 0.0 THEN 0.0::DOUBLE WHEN raw > 1.0 THEN 1.0::DOUBLE ELSE raw END AS cri,
               n_violations > 0 AS sad_flag FROM st),
st3 AS (SELECT *, CASE WHEN sad_flag THEN 'VETO' WHEN cri >= 0.9::DOUBLE AND tests_failed = 0 THEN 'OK' ELSE 'ABSTAIN' END
                  AS decision, lag(cri) OVER (PARTITION BY run ORDER BY tau_step) AS prev_cri FROM st2),
st4 AS (SELECT *, decision IN ('OK', 'VETO') OR (prev_cri IS NOT NULL AND abs(cri - prev_cri) < 0.05::DOUBLE) AS stop
        FROM st3),
kept AS (SELECT * FROM st4 QUALIFY min(CASE WHEN stop THEN tau_step END) OVER (PARTITION BY run) IS NULL
                                   OR tau_step <= min(CASE WHEN stop THEN tau_step END) OVER (PARTITION BY run))"""


@register("met01_step_metrics", oracle_cte("b_iter") + "," + _STEPS + """
SELECT run, tau_step, cri, sad_flag, decision, stop FROM st4""")
def met01(spark, sf):
    it = iteration_rows(spark, sf)
    from gavel.functions import metrics as M
    from pyspark.sql import Window
    w = Window.partitionBy("run_key").orderBy("tau_step")
    s = (it.where(F.col("tau_step") <= K.TAU_MAX)
         .withColumn("cri", M.cri_v1("total_tests", "tests_failed", "n_violations", "n_lint"))
         .withColumn("sad_flag", F.col("n_violations") > 0)
         .withColumn("decision", M.decide_v1("sad_flag", "cri", "tests_failed"))
         .withColumn("prev", F.lag("cri").over(w)))
    stop = F.col("decision").isin("OK", "VETO") | (F.col("prev").isNotNull()
                                                   & (F.abs(F.col("cri") - F.col("prev")) < K.PLATEAU_DELTA))
    return s.select("run", "tau_step", "cri", "sad_flag", "decision", stop.alias("stop"))


@register("win02_iteration_fold", oracle_cte("b_iter") + "," + _STEPS + """
SELECT run, arg_max(decision, tau_step) AS final_decision, CAST(count(*) AS BIGINT) AS iterations,
       array_to_string(list(printf('%.6f', cri) ORDER BY tau_step), ',') AS cri_history,
       CASE WHEN count(*) > 1 THEN arg_max(cri, tau_step) - arg_min(cri, tau_step) ELSE 0.0 END AS cri_improvement,
       max(tau_step) AS last_tau, arg_max(cri, tau_step) AS last_cri, arg_max(sad_flag, tau_step) AS last_sad,
       CAST(arg_max(total_tests - tests_failed, tau_step) AS BIGINT) AS last_tests_passed,
       CAST(arg_max(tests_failed, tau_step) AS BIGINT) AS last_tests_failed,
       CAST(arg_max(total_tests, tau_step) AS BIGINT) AS last_total_tests,
       arg_max_null(CASE WHEN total_tests > 0 THEN CAST(total_tests - tests_failed AS DOUBLE) / CAST(total_tests AS DOUBLE) END,
               tau_step) AS last_test_pass_rate,
       array_to_string(arg_max(violations, tau_step), ';') AS last_security_violations,
       CAST(arg_max(n_lint, tau_step) AS BIGINT) AS last_linter_errors_count
FROM kept GROUP BY run""")
def win02(spark, sf):
    f = O.iteration_fold(iteration_rows(spark, sf), by="run_key")
    return f.withColumn("cri_history", fmt6(F.col("cri_history"))).withColumn(
        "last_security_violations", F.array_join("last_security_violations", ";"))


@register("win06_cri_series", oracle_cte("b_iter") + "," + _STEPS + """
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY tau_step) AS BIGINT) AS step, cri,
       row_number() OVER (PARTITION BY run ORDER BY tau_step) = 1 AS is_first,
       row_number() OVER (PARTITION BY run ORDER BY tau_step DESC) = 1 AS is_last
FROM kept""")
def win06(spark, sf):
    return O.cri_series(O.iteration_fold(iteration_rows(spark, sf), by="run_key"))


@register("met14_baseline_summary", oracle_cte("b_iter") + """,
f AS (SELECT * FROM b_iter QUALIFY row_number() OVER (PARTITION BY run ORDER BY tau_step) = 1),
g AS (SELECT *, CASE WHEN total_tests > 0 THEN CAST(total_tests - tests_failed AS DOUBLE) / CAST(total_tests AS DOUBLE)
                     ELSE 0.0 END - 0.1::DOUBLE * n_violations - 0.02::DOUBLE * n_lint AS raw FROM f)
SELECT run, CAST(total_tests - tests_failed AS BIGINT) AS tests_passed, CAST(tests_failed AS BIGINT) AS tests_failed,
       CAST(total_tests AS BIGINT) AS total_tests,
       CASE WHEN total_tests > 0 THEN CAST(total_tests - tests_failed AS DOUBLE) / CAST(total_tests AS DOUBLE) END
         AS test_pass_rate,
       CAST(n_violations AS BIGINT) AS security_violation_count, CAST(n_lint AS BIGINT) AS linter_errors_count,
       CASE WHEN raw < 0.0 THEN 0.0::DOUBLE WHEN raw > 1.0 THEN 1.0::DOUBLE ELSE raw END AS cri,
       n_violations > 0 AS sad_flag, CAST(0 AS BIGINT) AS tau
FROM g""")
def met14(spark, sf):
    return O.baseline_summary(iteration_rows(spark, sf), by="run_key")


# ------------------------------------------------------------------ WIN-4/5/8
@register("win04_status_last_wins", oracle_cte("b_status_raw") + """
SELECT instance_id, status FROM b_status_raw WHERE instance_id IS NOT NULL AND status IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY file DESC, ts DESC, pos DESC) = 1""")
def win04(spark, sf):
    return merge_statuses(bridge(spark, sf, "b_status_raw"), order=("file", "ts", "pos"))


@register("win05_first_record", oracle_cte("b_eval") + """
SELECT task, model, final_decision, cri FROM b_eval ORDER BY seq LIMIT 1""")
def win05(spark, sf):
    return bridge(spark, sf, "b_eval").orderBy("seq").limit(1).select("task", "model", "final_decision", "cri")


@register("win08_first_k_candidates", oracle_cte("b_cands") + """
SELECT instance_id, cand_idx, candidate_dir FROM b_cands
QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY cand_idx) <= 3""")
def win08(spark, sf):
    return O.first_k(bridge(spark, sf, "b_cands"), "instance_id", ["cand_idx"], 3).select(
        "instance_id", "cand_idx", "candidate_dir")
