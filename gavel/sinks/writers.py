"""Sinks (SNK-1..11). Files are written by Spark tasks in parallel; where
the governed tool promises an order, rows carry ``seq`` and each output
file is sorted by it (a reader restores global order with the column).
Re-running a write replaces its output atomically per job (overwrite), so
a lost executor only repeats tasks, never leaves half a table behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: str | None = "seq", mode: str = "overwrite") -> None:
    """SNK-1/2/3/5/7/8: JSON lines (null fields kept for fixed schemas)."""
    out = df.sortWithinPartitions(order) if order and order in df.columns else df
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-6: CSV with a header (the sweep is a handful of rows: one file)."""
    df.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, key: str | None = None, buckets: int | None = None,
                mode: str = "overwrite") -> None:
    """SNK-4/9: one parquet table keyed by id instead of one file per row;
    with ``buckets`` the writer co-locates rows by key so later joins on the
    key need no shuffle (bucketed tables need a catalog; here the layout is
    a hash repartition on the key)."""
    out = df.repartition(buckets, key) if key and buckets else df
    out.write.mode(mode).parquet(path)


def instance_results(preds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """SNK-3: three fixed fields per prediction, defaults false/UNRESOLVED."""
    j = preds.select("instance_id").join(outcomes, "instance_id", "left")
    return j.select("instance_id", F.coalesce("resolved", F.lit(False)).alias("resolved"),
                    F.coalesce("resolved_status", F.lit("UNRESOLVED")).alias("resolved_status"))


def delete_statuses(statuses: DataFrame, ids: list[str], dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """SNK-10: remove ids from a status table. Returns (table after, rows
    removed); with ``dry_run`` the table is returned unchanged. Deleting
    again is a no-op (idempotent)."""
    spark = statuses.sparkSession
    id_df = spark.createDataFrame([(i,) for i in ids], "instance_id string")
    removed = statuses.join(id_df, "instance_id", "left_semi")
    if dry_run:
        return statuses, removed
    return statuses.join(id_df, "instance_id", "left_anti"), removed


def upsert_state(state: DataFrame, updates: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """SNK-9 resume state: union then the latest row per key."""
    both = state.unionByName(updates, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    return (both.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*"))
