"""Prompt assembly (TXT-25): a task's specification meets its starter code, its
last attempt and that attempt's checks, or its code snapshot.

The last attempt is found on (task, step) alone; only the texts of last
attempts are joined. Every join is on the task, so the joins share one exchange of
the specifications.

Defined cases: a task without attempts gets the first prompt; a missing starter,
snapshot or output is empty; missing lists are empty lists; of attempts that
share the last step the one with the greatest code counts; attempts without a
task take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.textops import build_patch_prompt, build_prompt


def last_attempts(attempts: DataFrame) -> DataFrame:
    """(task, step, code, output, lint, viol): each task's last attempt with its checks."""
    last = attempts.where(F.col("task").isNotNull()).groupBy("task").agg(F.max("step").alias("step"))
    rows = attempts.join(last, ["task", "step"])
    none = F.array().cast("array<string>")
    picked = F.max_by(F.struct("output", "lint", "viol"), F.struct("code", "output")).alias("c")
    return rows.groupBy("task", "step").agg(F.max("code").alias("code"), picked).select(
        "task", "step", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("c.output", F.lit("")).alias("output"),
        F.coalesce("c.lint", none).alias("lint"), F.coalesce("c.viol", none).alias("viol"))


def task_prompts(specs: DataFrame, starters: DataFrame, attempts: DataFrame) -> DataFrame:
    """(task, prompt) of specs (task, name, language, spec), starters (task,
    starter) and attempts (task, step, code, output, lint, viol)."""
    rows = specs.join(starters.select("task", "starter"), "task", "left").join(last_attempts(attempts), "task", "left")
    return rows.select("task", build_prompt(F.col("name"), F.col("language"), F.col("spec"), F.col("starter"), previous=F.col("code"),
                                            output=F.col("output"), lint=F.col("lint"), viol=F.col("viol")).alias("prompt"))


def patch_prompts(specs: DataFrame, snapshots: DataFrame, attempts: DataFrame) -> DataFrame:
    """(task, prompt) for repository tasks: specs (task, name, spec), snapshots
    (task, snapshot) and attempts as in ``task_prompts``."""
    rows = specs.join(snapshots.select("task", "snapshot"), "task", "left").join(
        last_attempts(attempts).drop("code"), "task", "left")
    return rows.select("task", build_patch_prompt(F.col("name"), F.col("spec"), F.col("snapshot"), F.col("step").isNotNull(),
                                                  F.col("output"), F.col("lint"), F.col("viol")).alias("prompt"))
