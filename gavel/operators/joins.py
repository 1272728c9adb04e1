"""Join operators (JN-5..14) and the id filters built on them.

Product-shaped joins of the original tool (experiment matrix, candidate
directories, threshold sweeps) are written as explodes of small parameter
lists or conditional aggregates, never as a join between two tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.textops import run_label, state_key


def selected(instance_id: Column, instances: str | None = None, user_filter: str | None = None) -> Column:
    """FLT-2: an id passes when the user's regex finds a match in it or the
    comma-separated list names it; without either every id passes."""
    listed = [i for i in map(str.strip, (instances or "").split(",")) if i]
    tests = ([instance_id.rlike(user_filter)] if user_filter else []) + ([instance_id.isin(listed)] if listed else [])
    return reduce(Column.__or__, tests) if tests else F.lit(True)


def attach_dataset(preds: DataFrame, index: DataFrame) -> DataFrame:
    """JN-5: predictions left join the dataset index; a miss is a failed
    scan with 'instance not found in dataset'."""
    j = preds.join(index.select("instance_id", "repo", "base_commit", F.lit(True).alias("_hit")), "instance_id", "left")
    return (j.withColumn("scan_failed", F.col("_hit").isNull())
            .withColumn("scan_error", F.when(F.col("_hit").isNull(), F.lit("instance not found in dataset")))
            .drop("_hit"))


def resolve_outcomes(preds: DataFrame, report_rows: DataFrame, log_rows: DataFrame) -> DataFrame:
    """JN-6 / SNK-3: evaluator report row, else newest log verdict, else
    (False, UNRESOLVED); three fixed fields per prediction."""
    r = report_rows.select("instance_id", F.col("resolved").alias("_rr"), F.col("resolved_status").alias("_rs"))
    lg = log_rows.select("instance_id", F.col("resolved").alias("_lr"), F.col("resolved_status").alias("_ls"))
    j = preds.select("instance_id").join(r, "instance_id", "left").join(lg, "instance_id", "left")
    has_r = F.col("_rs").isNotNull()
    has_l = F.col("_ls").isNotNull()
    return j.select("instance_id",
                    F.coalesce(F.when(has_r, F.col("_rr")).when(has_l, F.col("_lr")), F.lit(False)).alias("resolved"),
                    F.coalesce(F.when(has_r, F.col("_rs")).when(has_l, F.col("_ls")), F.lit("UNRESOLVED"))
                    .alias("resolved_status"))


def candidate_grid(preds_by_cand: DataFrame, candidate_dirs: list[str]) -> DataFrame:
    """JN-8: every id seen in any candidate x every candidate directory
    (a bounded explode of the K directories), absent ids -> empty patch."""
    ids = preds_by_cand.select("instance_id").distinct()
    dirs = F.array(*[F.struct(F.lit(i).alias("cand_pos"), F.lit(d).alias("candidate_dir"))
                     for i, d in enumerate(candidate_dirs)])
    grid = ids.select("instance_id", F.explode(dirs).alias("c")).select("instance_id", "c.*")
    return (grid.join(preds_by_cand, ["instance_id", "candidate_dir"], "left")
            .withColumn("patch", F.coalesce(F.col("patch"), F.lit(""))))


def skip_existing(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JN-9: resume; keep only keys without a finished output."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def rerun_marked(statuses: DataFrame, forced: Column) -> DataFrame:
    """JN-10 / SNK-10: statuses with ``removed``, true for the ids of a forced
    rerun; one pass over the table."""
    return statuses.withColumn("removed", F.coalesce(forced, F.lit(False)))


def experiment_matrix(instances: DataFrame, models: list[str], configs: list[str], repeats: int) -> DataFrame:
    """JN-13: models x configs x repeats x instances as explodes of the
    small parameter lists over the instance table."""
    m = F.explode(F.array(*[F.lit(x) for x in models]))
    c = F.explode(F.array(*[F.lit(x) for x in configs]))
    r = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    g = (instances.select("instance").withColumn("model", m).withColumn("config", c).withColumn("rep", r))
    return (g.withColumn("key", state_key("model", "config", "instance", "rep"))
            .withColumn("run_label", run_label("model", "config", "rep", "instance")))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """JN-14: file versions before x after by (instance, path); a missing side
    is null (no findings)."""
    return before.join(after, ["instance_id", "path"], "full").select("instance_id", "path", "before", "after")


def traj_diagnostics(trajs: DataFrame, preds: DataFrame) -> DataFrame:
    """JN-7: per trajectory the submission and prediction byte sizes and
    whether the prediction looks like a diff."""
    from gavel.functions.text import looks_like_diff
    j = trajs.join(preds.select("instance_id", F.col("model_patch").alias("_p")), "instance_id", "left")
    p = F.coalesce(F.col("_p"), F.lit(""))
    return j.select("instance_id", F.octet_length(F.coalesce(F.col("submission"), F.lit(""))).cast("bigint")
                    .alias("traj_bytes"), F.octet_length(p).cast("bigint").alias("pred_bytes"),
                    looks_like_diff(p).alias("pred_is_diff"))
