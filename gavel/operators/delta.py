"""Post-apply security delta (SEC-14), skip rule (FLT-3), report status
(SEC-15), scanner with fallback (SEC-12) and the AST scan job (SEC-10).

Input of the delta is a table of changed files ``(instance_id, path,
before, after)`` (the git worktree of the original tool is not rebuilt):
each file is scanned twice in one Arrow UDF pass, the new findings are a
Spark ``array_except`` and the per-instance union is a grouped aggregate
bounded by the files of one patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.security import substring_findings
from gavel.functions.text import py_strip
from gavel.operators.astscan import SCAN_ERROR_MARKER, SYNTAX_MARKER, rule_hits, scan_error, versions_facts

POSTAPPLY_RULES = K.RULE_FAMILIES


def skip_reason(status: Column, patch: Column) -> Column:
    """FLT-3: EMPTY_PATCH, infra text, or an infra status; else null."""
    p = py_strip(F.coalesce(patch, F.lit("")))
    low = F.lower(p)
    return (F.when(p == "", F.lit("EMPTY_PATCH"))
            .when(low.contains("timed out after") & low.contains("seconds"), F.lit(K.INFRA_TIMEOUT_LABEL))
            .when(F.upper(F.coalesce(status, F.lit(""))) == K.INFRA_TIMEOUT_LABEL, F.lit(K.INFRA_TIMEOUT_LABEL)))


def scan_files(files: DataFrame, code_col: str, rules=POSTAPPLY_RULES, rules_col: str | None = None) -> DataFrame:
    """SEC-10 job: adds ``findings`` and ``scan_error`` for each code row."""
    r = F.col(rules_col) if rules_col else F.array(*[F.lit(x) for x in rules]).cast("array<string>")
    code = F.coalesce(F.col(code_col), F.lit(""))
    return (files.withColumn("_s", F.get(versions_facts(F.array(code)), F.lit(0)))
            .withColumn("findings", rule_hits(F.col("_s"), r)).withColumn("scan_error", scan_error(F.col("_s"))).drop("_s"))


def file_deltas(files: DataFrame) -> DataFrame:
    """Per changed .py file: before/after findings, new = after - before
    (set), and the file's error text (before errors stop the file). Both
    versions go through one UDF call."""
    py = files.where(F.col("path").endswith(".py"))
    rules = F.array(*[F.lit(x) for x in POSTAPPLY_RULES])
    both = F.array(F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit("")))
    s = py.withColumn("_v", versions_facts(both))
    s = s.select("instance_id", "path", *[c for side, i in (("b", 0), ("a", 1)) for c in (
        rule_hits(F.get("_v", F.lit(i)), rules).alias(f"_{side}"), scan_error(F.get("_v", F.lit(i))).alias(f"_{side}err"))])
    err = (F.when(F.col("_berr").isNotNull(), F.concat(F.lit("before-scan failed for "), F.col("path"), F.lit(": "), F.col("_berr")))
           .when(F.col("_aerr").isNotNull(), F.concat(F.lit("after-scan failed for "), F.col("path"), F.lit(": "), F.col("_aerr"))))
    empty = F.array().cast("array<string>")
    before_v = F.coalesce(F.col("_b"), empty)
    after_v = F.when(F.col("_berr").isNotNull(), empty).otherwise(F.coalesce(F.col("_a"), empty))
    new_v = F.when(err.isNotNull(), empty).otherwise(F.array_sort(F.array_except(after_v, before_v)))
    return s.select("instance_id", "path", before_v.alias("before_violations"), after_v.alias("after_violations"),
                    new_v.alias("new_violations"), err.alias("file_error"))


def distinct_findings(rows: DataFrame, key: str, findings: str) -> DataFrame:
    """(key, findings): sorted union per key. Rows are exploded and the sets
    combine on the map side; a set is bounded by the rule vocabulary."""
    return (rows.select(key, F.explode_outer(findings).alias("_f")).groupBy(key)
            .agg(F.array_sort(F.collect_set("_f")).alias(findings)))


def postapply_reports(files: DataFrame) -> DataFrame:
    """SEC-14 / AGG-10: one report row per instance with the sorted union
    of new findings; any file error marks the scan failed (the last error
    in path order is kept) while other files' findings stay."""
    d = file_deltas(files)
    one = d.select("instance_id", "path", "file_error", F.posexplode_outer("new_violations").alias("_i", "_f"))
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0  # one row per file
    failed = F.col("file_error").isNotNull()
    return one.groupBy("instance_id").agg(
        F.array_sort(F.collect_set("_f")).alias("new_violations"),
        F.count_if(first & failed).alias("_errors"),
        F.max_by("file_error", F.when(failed, F.col("path"))).alias("scan_error"),
        F.count_if(first).cast("int").alias("n_files"),
    ).withColumn("scan_failed", F.col("_errors") > 0).withColumn(
        "scan_scope", F.lit(K.SCOPE_POSTAPPLY)).drop("_errors")


def report_status(skipped: Column, scan_failed: Column) -> Column:
    """SEC-15."""
    return (F.when(F.coalesce(skipped, F.lit(False)), F.lit("SKIPPED"))
            .when(F.coalesce(scan_failed, F.lit(False)), F.lit("FAILED")).otherwise(F.lit("OK")))


def scan_with_fallback(files: DataFrame, code_col: str, active=None) -> DataFrame:
    """SEC-12: AST findings unless the scan errored or produced only error
    markers, then the substring scanner. ``active=None`` means the AST scan
    gates everything out while the fallback uses its default rule ids."""
    rules = list(active) if active is not None else []
    s = scan_files(files, code_col, rules)
    markers = F.array(F.lit(SYNTAX_MARKER), F.lit(SCAN_ERROR_MARKER))
    real = F.array_except(F.coalesce(F.col("findings"), F.array().cast("array<string>")), markers)
    only_markers = (F.size(F.coalesce(F.col("findings"), F.array().cast("array<string>"))) > 0) & (F.size(real) == 0)
    fallback = F.col("scan_error").isNotNull() | only_markers
    has_marker = F.exists(F.coalesce(F.col("findings"), F.array().cast("array<string>")),
                          lambda x: x.isin(SYNTAX_MARKER, SCAN_ERROR_MARKER))
    chosen = (F.when(fallback, substring_findings(F.col(code_col), active))
              .when(has_marker, real).otherwise(F.col("findings")))
    return s.withColumn("violations", chosen).withColumn("sad_flag", F.size("violations") > 0)
