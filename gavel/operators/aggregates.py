"""Aggregations over governed eval rows and task-loop rows (AGG-1..14).

All are single-pass grouped aggregates with map-side partial aggregation;
none collects rows. Threshold sweeps use one conditional aggregate per
threshold (the list is a parameter of fixed, small size) instead of a
join, so the eval table is scanned once and never multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel import constants as K


def _ratio(n, d):
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def accept_predicate(threshold: float):
    """FLT-7: OK, not SAD, not scan-failed, cri >= t (null cri counts as 0)."""
    return ((F.col("final_decision") == "OK") & ~F.coalesce(F.col("sad_flag"), F.lit(False))
            & ~F.coalesce(F.col("security_scan_failed"), F.lit(False))
            & (F.coalesce(F.col("cri"), F.lit(0.0)) >= F.lit(float(threshold))))


def risk_coverage(evals: DataFrame, thresholds=K.SWEEP_THRESHOLDS) -> DataFrame:
    """AGG-4: per threshold total, accepted, coverage, false_accepts, risk,
    resolved_ok, veto, abstain. ``resolved`` is compared strictly (null is
    neither a false accept nor a resolved OK)."""
    return sweep_rows(evals.agg(*sweep_aggs(thresholds)), thresholds)


def sweep_aggs(thresholds=K.SWEEP_THRESHOLDS) -> list:
    """The one-pass conditional aggregates behind AGG-4 (also usable on a
    stream)."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("final_decision") == "VETO").alias("veto"),
            F.count_if(F.col("final_decision") == "ABSTAIN").alias("abstain")]
    for i, t in enumerate(thresholds):
        acc = accept_predicate(t)
        aggs += [F.count_if(acc).alias(f"a{i}"),
                 F.count_if(acc & (F.col("resolved") == F.lit(False))).alias(f"f{i}"),
                 F.count_if(acc & (F.col("resolved") == F.lit(True))).alias(f"r{i}")]
    return aggs


def sweep_rows(wide: DataFrame, thresholds=K.SWEEP_THRESHOLDS) -> DataFrame:
    """Turn the one-row wide aggregate into one row per threshold."""
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("accepted"),
                                        F.col(f"f{i}").alias("false_accepts"), F.col(f"r{i}").alias("resolved_ok"))
                               for i, t in enumerate(thresholds)]))
    out = wide.select("total", "veto", "abstain", rows.alias("s")).select(
        "s.threshold", F.col("total").cast("bigint").alias("total"), F.col("s.accepted").cast("bigint").alias("accepted"),
        "s.false_accepts", "s.resolved_ok", F.col("veto").cast("bigint").alias("veto"),
        F.col("abstain").cast("bigint").alias("abstain"))
    return (out.withColumn("coverage", _ratio(F.col("accepted"), F.col("total")))
            .withColumn("risk", _ratio(F.col("false_accepts"), F.col("accepted")))
            .select("threshold", "total", "accepted", "coverage", F.col("false_accepts").cast("bigint").alias("false_accepts"),
                    "risk", F.col("resolved_ok").cast("bigint").alias("resolved_ok"), "veto", "abstain"))


def ci_gate(evals: DataFrame) -> DataFrame:
    """AGG-3: totals by upper-cased decision (falsy -> ABSTAIN, unknown ->
    abstain); the gate passes iff there is no VETO."""
    d = F.upper(F.coalesce(F.nullif(F.col("final_decision"), F.lit("")), F.lit("ABSTAIN")))
    return (evals.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                      F.count_if(d == "OK").cast("bigint").alias("ok"),
                      F.count_if(~d.isin("OK", "VETO")).cast("bigint").alias("abstain"),
                      F.count_if(d == "VETO").cast("bigint").alias("veto"))
            .withColumn("passed", F.col("veto") == 0))


def frequency_tables(evals: DataFrame) -> DataFrame:
    """AGG-2: four frequency tables in ONE pass (grouping sets: one Expand,
    one partial + final aggregation). Nulls print as 'None'; scan_failed as
    true/false; falsy scopes are skipped. Rows carry ``first_seq`` so a
    caller can break count ties by first sight."""
    e = evals.select(
        F.coalesce(F.col("final_decision").cast("string"), F.lit("None")).alias("final_decision"),
        F.coalesce(F.col("resolved_status").cast("string"), F.lit("None")).alias("resolved_status"),
        F.when(F.coalesce(F.col("security_scan_failed"), F.lit(False)), F.lit("true")).otherwise(F.lit("false"))
        .alias("security_scan_failed"),
        F.nullif(F.col("security_scan_scope"), F.lit("")).alias("security_scan_scope"),
        F.col("seq"))
    g = e.sparkSession.sql("""
        SELECT final_decision, resolved_status, security_scan_failed, security_scan_scope,
               grouping_id() AS gid, count(*) AS n, min(seq) AS first_seq
        FROM {e}
        GROUP BY GROUPING SETS ((final_decision), (resolved_status), (security_scan_failed), (security_scan_scope))
    """, e=e)
    fields = ["final_decision", "resolved_status", "security_scan_failed", "security_scan_scope"]
    # grouping_id bit i (from the left) is 0 for the column grouped on
    field = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, name in enumerate(fields):
        gid = (1 << len(fields)) - 1 - (1 << (len(fields) - 1 - i))
        field = F.when(F.col("gid") == gid, F.lit(name)).otherwise(field)
        value = F.when(F.col("gid") == gid, F.col(name)).otherwise(value)
    out = g.select(field.alias("field"), value.alias("value"), F.col("n").cast("bigint").alias("count"), "first_seq")
    return out.where(~((F.col("field") == "security_scan_scope") & F.col("value").isNull()))


def snapshot(evals: DataFrame) -> DataFrame:
    """AGG-11: outcome and governance breakdown; coverage OK/(total-infra),
    accuracy (OK and resolved)/OK."""
    infra = F.coalesce(F.col("infra_timeout_before_patch"), F.lit(False))
    ok = F.col("final_decision") == "OK"
    s = evals.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                  F.count_if(infra).cast("bigint").alias("infra"),
                  F.count_if(F.col("resolved") == F.lit(True)).cast("bigint").alias("resolved"),
                  F.count_if(F.col("resolved") == F.lit(False)).cast("bigint").alias("unresolved"),
                  F.count_if(ok).cast("bigint").alias("ok"),
                  F.count_if(F.col("final_decision") == "ABSTAIN").cast("bigint").alias("abstain"),
                  F.count_if(F.col("final_decision") == "VETO").cast("bigint").alias("veto"),
                  F.count_if(ok & (F.col("resolved") == F.lit(True))).cast("bigint").alias("ok_resolved"))
    return (s.withColumn("coverage", _ratio(F.col("ok"), F.col("total") - F.col("infra")))
            .withColumn("accuracy", _ratio(F.col("ok_resolved"), F.col("ok"))))


def multi_key_counts(evals: DataFrame, fields=("final_decision", "resolved_status", "eval_status",
                                               "security_scan_scope", "model")) -> DataFrame:
    """AGG-12: 'field:value' -> n over several fields via one unpivot."""
    stacked = evals.select(F.explode(F.array(*[
        F.concat(F.lit(f + ":"), F.coalesce(F.col(f).cast("string"), F.lit("None"))) for f in fields])).alias("key"))
    return stacked.groupBy("key").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def violation_counts(evals: DataFrame) -> DataFrame:
    """AGG-9: per row high / info finding counts and any-high."""
    from gavel.functions.metrics import any_high, empty_arr, high_count
    v = F.coalesce(F.col("security_violations"), empty_arr())
    return evals.select("task", high_count(v).cast("bigint").alias("high"),
                        (F.size(v) - high_count(v)).cast("bigint").alias("info"), any_high(v).alias("any_high"))


def confusion(evals: DataFrame) -> DataFrame:
    """AGG-14: decision x resolved confusion counts."""
    return (evals.groupBy(F.coalesce(F.col("final_decision"), F.lit("None")).alias("final_decision"),
                          F.coalesce(F.col("resolved").cast("string"), F.lit("None")).alias("resolved"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def calibration(evals: DataFrame, bins: int = 10) -> DataFrame:
    """AGG-14: expected calibration error of cri against resolved over
    equal-width bins (rows with a known outcome only)."""
    e = evals.where(F.col("resolved").isNotNull()).select(
        F.least(F.floor(F.coalesce(F.col("cri"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("bigint").alias("bin"),
        F.coalesce(F.col("cri"), F.lit(0.0)).alias("cri"), F.col("resolved").cast("double").alias("y"))
    per_bin = e.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("cri").alias("sc"), F.sum("y").alias("sy"))
    return per_bin.agg(F.sum("n").cast("bigint").alias("n"),
                       (F.sum(F.abs(F.col("sc") - F.col("sy"))) / F.sum("n")).alias("ece"))


def conformal_thresholds(evals: DataFrame, alphas: list[str], bins: int = 1024) -> DataFrame:
    """AGG-14: conformal risk control. For each target ``alpha`` (decimal text)
    the smallest ``tau`` so that accepting ``cri > tau`` keeps the expected share
    of accepted but unresolved rows at or below alpha: with n rows of known
    outcome, (accepted unresolved + 1) / (n + 1) <= alpha. So tau is the
    floor(alpha * (n + 1))-th largest cri of the unresolved rows; infinity where
    that rank is 0 (nothing can be promised), minus infinity where there are fewer
    (everything can be accepted).

    The order statistic is exact and sorts nothing: each pass counts the rows of
    the interval that holds a rank in ``bins`` equal bins, then goes on between
    the smallest and largest value of the bin that holds it. All alphas share a
    pass, and a pass returns at most ``bins`` rows an alpha."""
    from decimal import Decimal
    from math import inf

    e = evals.where(F.col("resolved").isNotNull()).select(
        F.coalesce(F.col("cri").cast("double"), F.lit(0.0)).alias("cri"), F.col("resolved"))
    wrong = e.where("not resolved").select("cri")
    failed = F.when(~F.col("resolved"), F.col("cri"))
    total = e.agg(F.count(F.lit(1)).alias("n"), F.count(failed).alias("wrong"), F.min(failed).alias("lo"), F.max(failed).alias("hi")).first()
    taus, live = {}, {}
    for alpha in alphas:
        rank = int(Decimal(alpha) * (total["n"] + 1))
        if rank < 1 or rank > total["wrong"]:
            taus[alpha] = inf if rank < 1 else -inf
        else:
            live[alpha] = (total["lo"], total["hi"], rank)
    while live:
        names = list(live)
        places = [F.when(F.col("cri").between(lo, hi), F.struct(F.lit(i).alias("i"), F.least(F.lit(bins - 1), F.floor(
            (F.col("cri") - lo) / (hi - lo) * bins) if hi > lo else F.lit(0)).cast("int").alias("bin")))
            for i, (lo, hi, _) in enumerate(live.values())]
        seen = wrong.select("cri", F.explode(F.array_compact(F.array(*places))).alias("p")).groupBy("p").agg(
            F.count(F.lit(1)).alias("n"), F.min("cri").alias("lo"), F.max("cri").alias("hi")).select("p.*", "n", "lo", "hi")
        counts = sorted(seen.collect(), key=lambda r: (r["i"], -r["bin"]))
        for i, alpha in enumerate(names):
            rank = live[alpha][2]
            for r in (r for r in counts if r["i"] == i):
                if rank <= r["n"]:
                    break
                rank -= r["n"]
            live[alpha] = (r["lo"], r["hi"], rank)
            if r["lo"] == r["hi"]:
                taus[alpha] = live.pop(alpha)[0]
    found = [F.struct(F.lit(a).alias("alpha"), F.lit(float(taus[a])).alias("tau"),
                      F.count_if(F.col("cri") > F.lit(float(taus[a]))).alias("accepted"),
                      F.count_if((F.col("cri") > F.lit(float(taus[a]))) & ~F.col("resolved")).alias("wrong_accepted")) for a in alphas]
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("resolved")).alias("n_wrong"), F.array(*found).alias("f")).select(
        F.explode("f").alias("f"), "n", "n_wrong").select(F.col("f.alpha").alias("alpha"), "n", "n_wrong", "f.tau", "f.accepted", "f.wrong_accepted")


# ------------------------------------------------------------ task loop rows
def model_summary(loop: DataFrame) -> DataFrame:
    """AGG-5: per model: unique tasks, baseline full passes, wrapped
    OK/ABSTAIN/VETO, where the LAST row per (model, task, type) wins."""
    last = (loop.groupBy("model", "task", "type")
            .agg(F.max_by(F.struct("total_tests", "tests_passed", "final_decision"), F.col("seq")).alias("r")))
    full = ((F.col("type") == "baseline") & (F.coalesce(F.col("r.total_tests"), F.lit(0)) != 0)
            & (F.col("r.tests_passed") == F.col("r.total_tests")))
    wd = F.when(F.col("type") == "wrapped", F.col("r.final_decision"))
    return last.groupBy("model").agg(
        F.count_distinct("task").cast("bigint").alias("tasks"),
        F.count_if(full).cast("bigint").alias("baseline_full_pass"),
        F.count_if(wd == "OK").cast("bigint").alias("wrapped_ok"),
        F.count_if(wd == "ABSTAIN").cast("bigint").alias("wrapped_abstain"),
        F.count_if(wd == "VETO").cast("bigint").alias("wrapped_veto"))


def model_task_comparison(loop: DataFrame) -> DataFrame:
    """AGG-6 / JN-11: per (model, task) the FIRST baseline and FIRST wrapped
    row side by side (a pivot on type, no self join)."""
    b = F.col("type") == "baseline"
    w = F.col("type") == "wrapped"
    first = lambda of, col: F.min_by(F.when(of, F.col(col)), F.when(of, F.col("seq")))
    return loop.groupBy("model", "task").agg(
        first(b, "test_pass_rate").alias("baseline_pass_rate"),
        first(b, "security_violation_count").alias("baseline_security_violations"),
        first(w, "final_decision").alias("wrapped_final_decision"),
        first(w, "last_test_pass_rate").alias("wrapped_last_pass_rate"),
        first(w, "cri_history").alias("wrapped_cri_history"),
        first(w, "last_security_violations").alias("wrapped_last_security_violations"),
        F.count_if(b).cast("bigint").alias("n_baseline"), F.count_if(w).cast("bigint").alias("n_wrapped"))


def run_summary(loop: DataFrame) -> DataFrame:
    """AGG-7: baseline/wrapped exact-pass counts (rate == 1.0), percentages
    and improvement in points."""
    b = F.col("type") == "baseline"
    w = F.col("type") == "wrapped"
    s = loop.agg(F.count_if(b).cast("bigint").alias("tasks"),
                 F.count_if(b & (F.col("test_pass_rate") == 1.0)).cast("bigint").alias("baseline_pass"),
                 F.count_if(w & (F.col("last_test_pass_rate") == 1.0)).cast("bigint").alias("wrapped_pass"))
    pct = lambda c: F.when(F.col("tasks") > 0, F.col(c) * 100.0 / F.col("tasks"))
    return (s.withColumn("baseline_pct", pct("baseline_pass")).withColumn("wrapped_pct", pct("wrapped_pass"))
            .withColumn("improvement_pts", F.when(F.col("tasks") > 0, (F.col("wrapped_pass") - F.col("baseline_pass"))
                                                  / F.col("tasks") * 100.0)))
