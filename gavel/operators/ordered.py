"""Order-dependent operators (WIN-1..9) without relying on row order.

Picks use ``min_by``/``max_by`` over an explicit ordering struct: they
aggregate partially on the map side, so a hot key costs one candidate row
per task before the shuffle instead of a sorted partition. Sequential folds
use windows over an explicit order column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions import metrics as M
from gavel.functions.security import diff_scan_failed, with_diff_scan
from gavel.functions.text import changed_file_count
from gavel.operators.joins import candidate_grid
from gavel.operators.pycheck import python_scan_ok
from gavel.session import written


def first_wins(df: DataFrame, key: str, order: str | list, value_cols=None) -> DataFrame:
    """WIN-5 / AGG-6 building block: the row with the smallest ``order``."""
    order_cols = [order] if isinstance(order, str) else list(order)
    cols = value_cols or [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order_cols)).alias("_r"))
            .select(key, "_r.*"))


def evaluate_candidates(cands: DataFrame) -> DataFrame:
    """MET-12/13 per candidate: SAD = any finding, decision, tier, tolerant
    cri (null -> 0.0), changed-file count and patch size when a patch is
    given (candidate patches are taken as is)."""
    c = cands
    if "patch" in c.columns:
        c = (c.withColumn("changed_files", changed_file_count(F.coalesce(F.col("patch"), F.lit(""))).cast("bigint"))
             .withColumn("patch_size", F.length(F.coalesce(F.col("patch"), F.lit(""))).cast("bigint")))
    sad = F.size(F.coalesce(F.col("security_violations"), M.empty_arr())) > 0
    c = (c.withColumn("sad_flag", sad)
         .withColumn("resolved", F.coalesce(F.col("resolved"), F.lit(False)))
         .withColumn("cri", F.coalesce(F.col("cri").try_cast("double"), F.lit(0.0)))
         .withColumn("security_scan_failed", F.coalesce(F.col("security_scan_failed"), F.lit(False))))
    c = c.withColumn("final_decision", M.candidate_decision("sad_flag", "security_scan_failed", "resolved"))
    return c.withColumn("tier", M.candidate_tier("final_decision", "resolved"))


def best_of_k(cands: DataFrame) -> DataFrame:
    """WIN-1: per instance the candidate minimising (tier, -cri,
    changed_files, patch_size), ties by candidate order."""
    e = evaluate_candidates(cands)
    key = F.struct(F.col("tier"), (F.lit(0.0) - F.col("cri")).alias("ncri"), F.col("changed_files"),
                   F.col("patch_size"), F.col("cand_idx"))
    keep = [c for c in e.columns if c != "instance_id"]
    return (e.groupBy("instance_id").agg(F.min_by(F.struct(*keep), key).alias("b"),
                                         F.count(F.lit(1)).cast("bigint").alias("n_candidates"))
            .select("instance_id", "b.*", "n_candidates"))


SELECTION_FIELDS = ["candidate_dir", "instance_id", "patch", "resolved", "resolved_status", "cri", "security_violations",
                    "security_scan_failed", "security_scan_scope", "sad_flag", "final_decision", "changed_files", "patch_size",
                    "security_report_found"]


def select_candidates(preds: DataFrame, candidate_dirs: list[str], results: DataFrame, reports: DataFrame) -> DataFrame:
    """JN-8 -> results and reports -> MET-12 -> WIN-1: per instance the best of
    the candidate directories, with all fields of the selection report.

    preds   : (instance_id, candidate_dir, patch); absent pairs have an empty patch
    results : (instance_id, candidate_dir, resolved, resolved_status, cri)
    reports : (instance_id, candidate_dir, scan_scope, scan_failed, new_violations)
    A candidate without a report is scanned from its diff, before the joins."""
    key = ["instance_id", "candidate_dir"]
    grid = with_diff_scan(candidate_grid(preds.select(*key, "patch"), candidate_dirs), "patch")
    grid = grid.withColumn("_parse_ok", python_scan_ok(F.col("_ds_parse_in")))
    rows = (grid.join(results.select(*key, "resolved", "resolved_status", "cri"), key, "left")
            .join(reports.select(*key, "scan_scope", "scan_failed", "new_violations", F.lit(True).alias("_found")), key, "left"))
    found = F.coalesce("_found", F.lit(False))
    diff_failed = diff_scan_failed(F.lit(False), F.col("_ds_light"), F.col("_ds_haspy"), F.col("_ds_blank"), F.col("_parse_ok"))
    rows = rows.withColumns({
        "security_report_found": found,
        "security_violations": F.when(found, F.coalesce("new_violations", M.empty_arr())).otherwise(F.col("_ds_light")),
        "security_scan_failed": F.when(found, F.coalesce("scan_failed", F.lit(False))).otherwise(diff_failed),
        "security_scan_scope": F.when(found, F.coalesce("scan_scope", F.lit(K.SCOPE_POSTAPPLY))).otherwise(F.lit(K.SCOPE_FALLBACK)),
        "cand_idx": F.col("cand_pos")})
    return best_of_k(rows).select(*SELECTION_FIELDS)


def iteration_steps(iters: DataFrame, tau_max: int = K.TAU_MAX, threshold: float = K.CRI_THRESHOLD,
                    plateau: float = K.PLATEAU_DELTA, early_stop_plateau: bool = True, by: str = "run") -> DataFrame:
    """MET-1/2 + WIN-2: per-step metrics and decision, the stop rule, and
    only the steps the loop would have run (tau <= first stop). Runs are told
    apart by ``by``, a column in one-to-one relation with ``run``."""
    w = Window.partitionBy(by).orderBy("tau_step")
    if "violations" not in iters.columns:
        iters = iters.withColumn("violations", F.lit(None).cast("array<string>"))
    s = (iters.where(F.col("tau_step") <= tau_max)
         .withColumn("cri", M.cri_v1("total_tests", "tests_failed", "n_violations", "n_lint"))
         .withColumn("sad_flag", F.col("n_violations") > 0)
         .withColumn("decision", M.decide_v1("sad_flag", "cri", "tests_failed", threshold))
         .withColumn("prev_cri", F.lag("cri").over(w)))
    stop = F.col("decision").isin("OK", "VETO")
    if early_stop_plateau:
        stop = stop | (F.col("prev_cri").isNotNull() & (F.abs(F.col("cri") - F.col("prev_cri")) < F.lit(plateau)))
    s = s.withColumn("stop", stop)
    first_stop = F.min(F.when(F.col("stop"), F.col("tau_step"))).over(Window.partitionBy(by))
    return s.withColumn("_first_stop", first_stop).where(
        F.col("_first_stop").isNull() | (F.col("tau_step") <= F.col("_first_stop"))).drop("_first_stop")


def iteration_fold(iters: DataFrame, by: str = "run", **kw) -> DataFrame:
    """WIN-2 + WIN-3: the wrapped-run summary per run."""
    s = iteration_steps(iters, by=by, **kw)
    last = F.max_by(F.struct("tau_step", "cri", "sad_flag", "total_tests", "tests_failed", "n_lint",
                             "decision", "violations", *(["run"] if by != "run" else [])), F.col("tau_step"))
    g = s.groupBy(by).agg(
        last.alias("l"), F.count(F.lit(1)).cast("bigint").alias("iterations"),
        F.array_sort(F.collect_list(F.struct("tau_step", "cri"))).alias("_h"),
        F.min_by("cri", "tau_step").alias("_first"))
    tp = F.col("l.total_tests") - F.col("l.tests_failed")
    return g.select(
        "run" if by == "run" else "l.run", F.col("l.decision").alias("final_decision"), "iterations",
        F.transform("_h", lambda x: x["cri"]).alias("cri_history"),
        F.when(F.col("iterations") > 1, F.col("l.cri") - F.col("_first")).otherwise(F.lit(0.0)).alias("cri_improvement"),
        F.col("l.tau_step").alias("last_tau"), F.col("l.cri").alias("last_cri"), F.col("l.sad_flag").alias("last_sad"),
        tp.cast("bigint").alias("last_tests_passed"), F.col("l.tests_failed").cast("bigint").alias("last_tests_failed"),
        F.col("l.total_tests").cast("bigint").alias("last_total_tests"),
        F.when(F.col("l.total_tests") > 0, tp.cast("double") / F.col("l.total_tests").cast("double"))
        .alias("last_test_pass_rate"),
        F.col("l.violations").alias("last_security_violations"),
        F.col("l.n_lint").cast("bigint").alias("last_linter_errors_count"))


def baseline_summary(iters: DataFrame, by: str = "run") -> DataFrame:
    """MET-14: the baseline row (tau 0 in the loop; here the first step),
    pass rate null when there are no tests. ``by`` as in ``iteration_steps``."""
    first = first_wins(iters, by, "tau_step", ["total_tests", "tests_failed", "n_violations", "n_lint",
                                              *(["run"] if by != "run" else [])])
    tp = F.col("total_tests") - F.col("tests_failed")
    return first.select(
        "run", tp.cast("bigint").alias("tests_passed"), F.col("tests_failed").cast("bigint"),
        F.col("total_tests").cast("bigint"),
        F.when(F.col("total_tests") > 0, tp.cast("double") / F.col("total_tests").cast("double")).alias("test_pass_rate"),
        F.col("n_violations").cast("bigint").alias("security_violation_count"),
        F.col("n_lint").cast("bigint").alias("linter_errors_count"),
        M.cri_v1("total_tests", "tests_failed", "n_violations", "n_lint").alias("cri"),
        (F.col("n_violations") > 0).alias("sad_flag"), F.lit(0).cast("bigint").alias("tau"))


def cri_series(wrapped: DataFrame) -> DataFrame:
    """WIN-6: one row per (run, step) of the cri history with first/last
    labels, for charting."""
    return (wrapped.select("run", F.posexplode("cri_history").alias("step", "cri"),
                           F.size("cri_history").alias("_n"))
            .select("run", (F.col("step") + 1).cast("bigint").alias("step"), "cri",
                    (F.col("step") == 0).alias("is_first"), (F.col("step") == F.col("_n") - 1).alias("is_last")))


def newest(df: DataFrame, key: str, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """WIN-7: newest file per key by modification time (path breaks ties)."""
    return df.groupBy(key).agg(F.max_by(F.col(path), F.struct(F.col(mtime), F.col(path))).alias(path))


def first_k(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """WIN-8: first k rows per group (k is a fixed small parameter)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


BUCKETS = 4096
FINER = 256  # a bucket that differs is told apart in so many parts


def _sides(a: DataFrame, b: DataFrame, buckets: int) -> tuple[DataFrame, list[str]]:
    """Both tables by column name with the side (1, -1), two digests of the row and
    its bucket. The digests read the row as canonical JSON, nulls kept."""
    cols = sorted(a.columns)
    if sorted(b.columns) != cols:
        raise ValueError(f"columns differ: {cols} and {sorted(b.columns)}")
    both = a.select(*cols, F.lit(1).alias("__side")).unionByName(b.select(*cols, F.lit(-1).alias("__side")))
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {
        "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    digests = F.transform(F.array(text), lambda t: F.struct(F.xxhash64(t).alias("x"), F.xxhash64(t, F.lit("second")).alias("y")))[0]
    return both.withColumn("__d", digests).withColumns({
        "__bucket": F.pmod(F.col("__d.x"), F.lit(buckets)).cast("int"),
        "__part": F.pmod(F.col("__d.x"), F.lit(buckets * FINER)).cast("int")}), cols


def _digests(sides: DataFrame, by: str = "__bucket") -> DataFrame:
    """A row a bucket: counts of both sides and whether they can differ. The sums
    do not depend on order; repeated rows count."""
    def total(name):
        return F.sum(F.col(f"__d.{name}").cast("decimal(20,0)") * F.col("__side"))
    return sides.groupBy(by).agg(
        F.count_if(F.col("__side") > 0).alias("left_rows"), F.count_if(F.col("__side") < 0).alias("right_rows"),
        total("x").alias("x"), total("y").alias("y")).select(
        by, "left_rows", "right_rows",
        ((F.col("left_rows") != F.col("right_rows")) | (F.col("x") != 0) | (F.col("y") != 0)).alias("differs"))


def row_differences(a: DataFrame, b: DataFrame, buckets: int = BUCKETS, digests: DataFrame | None = None) -> DataFrame:
    """SET-5: the rows that the tables do not share, with ``only_left`` and
    ``only_right`` (how often more they stand there).

    Rows meet by commutative digests of buckets (two independent 64-bit
    sums): equal tables shuffle a row a bucket and task, nothing else. Buckets that
    differ are digested again in ``FINER`` parts, and only rows of parts that
    differ are compared by value; the lists of buckets and of parts (``buckets``
    and ``buckets * FINER`` numbers at most) are broadcast. Columns go by name, types are
    brought together as in a union; map columns cannot be compared."""
    sides, cols = _sides(a, b, buckets)
    where = (_digests(sides) if digests is None else digests).where("differs").select("__bucket")
    parts = _digests(sides.join(F.broadcast(where), "__bucket", "left_semi"), "__part").where("differs").select("__part")
    drilled = sides.join(F.broadcast(parts), "__part", "left_semi")  # at most a million numbers
    names = [F.col(f"`{c}`") for c in cols]
    counted = drilled.groupBy(*names).agg(F.sum("__side").alias("__n")).where("__n <> 0")
    return counted.select(*names, F.greatest("__n", F.lit(0)).cast("bigint").alias("only_left"),
                          F.greatest(-F.col("__n"), F.lit(0)).cast("bigint").alias("only_right"))


def rows_equal(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """SET-5: one row with the numbers of rows only in a, only in b, in a and in b
    (duplicates counted); see ``row_differences``."""
    digests = written(_digests(_sides(a, b, buckets)[0]), "digests")  # a row a bucket, used twice
    only = row_differences(a, b, buckets, digests).agg(
        F.coalesce(F.sum("only_left"), F.lit(0)).alias("only_left"), F.coalesce(F.sum("only_right"), F.lit(0)).alias("only_right"))
    rows = digests.agg(F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"))
    return a.sparkSession.sql("SELECT (SELECT struct(only_left, only_right) FROM {x}) AS only, left_rows, right_rows FROM {y}",
                              x=only, y=rows).select("only.*", "left_rows", "right_rows")


def pack_context(files: DataFrame, max_changed: int = 5, max_tests: int = 3) -> DataFrame:
    """TXT-26: per instance, the explicit files if any exist, else the first
    ``max_changed`` changed .py files (listing order); then the first
    ``max_tests`` test files by path. Sections '=== path ===' (tests marked
    ' (tests)') joined by newlines; bounded by k files per instance."""
    w_changed = Window.partitionBy("instance_id").orderBy("pos")
    w_tests = Window.partitionBy("instance_id").orderBy("path")
    has_explicit = F.max((F.col("kind") == "explicit").cast("int")).over(Window.partitionBy("instance_id")) > 0
    f = files.withColumn("_has_exp", has_explicit)
    explicit = f.where(F.col("kind") == "explicit").select("instance_id", F.lit(0).alias("sec"), "pos", "path", "content")
    changed = (f.where((F.col("kind") == "changed") & ~F.col("_has_exp") & F.col("path").endswith(".py"))
               .withColumn("_rn", F.row_number().over(w_changed)).where(F.col("_rn") <= max_changed)
               .select("instance_id", F.lit(1).alias("sec"), "pos", "path", "content"))
    tests = (f.where(F.col("kind") == "test").withColumn("_rn", F.row_number().over(w_tests))
             .where(F.col("_rn") <= max_tests)
             .select("instance_id", F.lit(2).alias("sec"), F.col("_rn").cast("bigint").alias("pos"), "path", "content"))
    parts = explicit.unionByName(changed).unionByName(tests)
    text = F.when(F.col("sec") == 2, F.concat(F.lit("=== "), F.col("path"), F.lit(" (tests) ===\n"), F.col("content"),
                                             F.lit("\n"))) \
        .otherwise(F.concat(F.lit("=== "), F.col("path"), F.lit(" ===\n"), F.col("content"), F.lit("\n")))
    return (parts.groupBy("instance_id")
            .agg(F.array_sort(F.collect_list(F.struct("sec", "pos", text.alias("t")))).alias("_s"))
            .select("instance_id", F.array_join(F.transform("_s", lambda x: x["t"]), "\n").alias("context")))
