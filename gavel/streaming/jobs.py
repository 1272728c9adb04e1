"""Structured Streaming forms of the batch jobs (STR-1..7).

Sources are file streams over the tables, each one file or a folder of part
files whose order means nothing; state and progress live under the session's shared
checkpoint folder so a restarted query resumes exactly. Each ``run_*``
helper drains the available input (``availableNow``) into a sink and returns
the result as a batch DataFrame, which is what the registered queries and
tests compare with the batch operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gavel import constants as K
from gavel.session import ensure_checkpoint_dir, written
from gavel.sinks.keyed import KeyedTable
from gavel.streaming.ordered import LIMITER_OUT, SESSION_OUT, LimiterProcessor, SessionProcessor

FILES_A_TRIGGER = 64  # static sides are read again in every micro-batch


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    files = table.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        path = f"{sf_dir}/{name}.parque[t]"  # a stream takes a single file only through a glob
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", FILES_A_TRIGGER).parquet(path)


def _location(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{label}-{uuid.uuid4().hex[:12]}"


def drain(df: DataFrame, label: str) -> DataFrame:
    """Run ``df`` (append mode) until the available input is consumed, into a
    parquet table under the shared folder; return that table."""
    spark = df.sparkSession
    path = _location(spark, label)
    (df.writeStream.format("parquet").option("path", f"{path}/table").outputMode("append")
     .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def drain_latest(df: DataFrame, label: str) -> DataFrame:
    """Run ``df`` (complete mode, a bounded result) until the available input
    is consumed; every epoch writes its own version of the result, so a retried
    epoch overwrites itself. Returns the newest version."""
    spark = df.sparkSession
    path = _location(spark, label)
    q = (df.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/v{epoch}"))
         .outputMode("complete").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    q.awaitTermination()
    done = [p["batchId"] for p in q.recentProgress]
    if not done:  # no input at all: what the aggregate gives on an empty table
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/v{max(done)}")


def start_to_parquet(df: DataFrame, label: str, path: str, processing_time: str | None = "1 minute"):
    """Production form: append the stream to a parquet table with its
    progress and state under the shared checkpoint folder (exactly-once file
    sink; a restarted query resumes from the checkpoint). Returns the
    running ``StreamingQuery``."""
    w = (df.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{label}"))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


def governed_eval_stream(spark: SparkSession, predictions: DataFrame, statuses: DataFrame, results: DataFrame,
                         reports: DataFrame | None, model_id: str, allow_diff_fallback: bool = True) -> DataFrame:
    """STR-1 transformation for any streaming predictions source
    (instance_id, model_patch, ...): stream-static left joins, append-only."""
    from gavel.operators.governance import governed_eval
    return governed_eval(predictions, statuses, results, reports, model_id=model_id,
                         allow_diff_fallback=allow_diff_fallback)


# ------------------------------------------------------------------ STR-1
def governed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed evaluation over arriving predictions: stream-static left
    joins to the status, result and report tables; append mode."""
    from gavel.operators.governance import governed_eval
    from gavel.plans.q_governance import MODEL_ID, present
    from gavel.sources.bridges import SPARK, bridge, sql_for
    from gavel.sources.files import merge_statuses

    docs = stream_table(spark, sf_dir, "documents")
    preds = spark.sql(sql_for("b_preds", SPARK, {"documents": "{documents}"}), documents=docs).drop("form")
    statuses = merge_statuses(bridge(spark, sf_dir, "b_status_raw"), order=("file", "ts", "pos"))
    ev = governed_eval(preds, statuses, bridge(spark, sf_dir, "b_results"), bridge(spark, sf_dir, "b_reports"),
                       model_id=MODEL_ID, allow_diff_fallback=True)
    return drain(present(ev), "governed")


# ------------------------------------------------------------------ STR-2, STR-3
def _eval_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.sources.bridges import SPARK, sql_for
    li = stream_table(spark, sf_dir, "lineitem")
    return spark.sql(sql_for("b_eval", SPARK, {"lineitem": "{lineitem}"}), lineitem=li)


def decision_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running decision counts (complete mode); the CI gate reads them."""
    ev = _eval_stream(spark, sf_dir)
    counts = ev.groupBy("final_decision").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return drain_latest(counts, "decisions")


def risk_coverage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running risk/coverage: the sweep's one-pass aggregate on the stream
    (complete mode), unpivoted per threshold on read."""
    from gavel.operators.aggregates import sweep_aggs, sweep_rows
    ev = _eval_stream(spark, sf_dir)
    wide = drain_latest(ev.agg(*sweep_aggs()), "sweep")
    return sweep_rows(wide)


# ------------------------------------------------------------------ ordered streams
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END_OF_STREAM = "2200-01-01 00:00:00"  # a time that pandas can hold


def _spread(rows: DataFrame, column: str) -> str:
    """The time between a table's oldest and newest row, as an interval."""
    r = rows.agg((F.max(column).cast("timestamp").cast("long") - F.min(column).cast("timestamp").cast("long")).alias("s")).first()
    return f"{int(r['s'] or 0) + 1} seconds"


def drain_in_order(rows: DataFrame, job: Callable[[DataFrame], DataFrame], label: str, progress: list | None = None) -> DataFrame:
    """Run ``job`` over ``rows`` with the column ``event_time`` until the input
    is consumed, then close the stream: a marker row (every other column null)
    moves the watermark past all rows, so what still waits in the state leaves.

    The marker comes as a file of its own once the input is consumed, to the
    same query with the same checkpoint; a job skips rows with ``closing``.
    Spark's watermark starts at 1970: rows of that instant or before are late.
    ``progress`` takes the reports of the micro-batches."""
    spark = rows.sparkSession
    path = _location(spark, label)
    marker = spark.createDataFrame([(True,)], "closing boolean").select(
        F.lit(END_OF_STREAM).cast("timestamp").alias("event_time"), "closing")
    marker.limit(0).write.parquet(f"{path}/closing")
    closing = spark.readStream.schema(marker.schema).parquet(f"{path}/closing")
    out = job(rows.withColumn("closing", F.lit(False)).unionByName(closing, allowMissingColumns=True))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)  # list and map state, timers
    try:
        for last in (False, True):
            if last:
                marker.coalesce(1).write.mode("append").parquet(f"{path}/closing")
            q = (out.writeStream.format("parquet").option("path", f"{path}/table").outputMode("append")
                 .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
            q.awaitTermination()
            if progress is not None:
                progress += q.recentProgress
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{path}/table")


GROUPS = 256  # keys of the state: users or chains share them by hash
BUCKETS_WAITING = 16  # buckets of time that the lateness spans; a row waits at most one bucket longer than it


def _bucket_ms(spark: SparkSession, lateness: str) -> int:
    micros = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{lateness}') AS n").first()["n"]
    return max(1, micros // 1000 // BUCKETS_WAITING)


def _group(closing: str, key: Column, groups: int) -> Column:
    return F.when(F.col(closing), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(groups))).cast("int")


# ------------------------------------------------------------------ STR-4
def limiter_over(requests: DataFrame, lateness: str, unit: int = 1, window: int = K.LIMITER_WINDOW,
                 limit: int = K.LIMITER_LIMIT, groups: int = GROUPS) -> DataFrame:
    """Greedy limiter on a stream of (event_id, user_id, ts_unit, event_time,
    closing); ``event_time`` is the start of the unit, ``unit`` its seconds.

    Requests wait in the state until the watermark passes their bucket of time and
    are decided in order of (ts_unit, event_id), so the result does not depend on
    files or micro-batches. Requests later than ``lateness`` are dropped and
    counted by the watermark (``numRowsDroppedByWatermark``). The state of a
    user is at most ``limit`` waiting ids a unit and ``limit`` allowed times."""
    width = max(1, _bucket_ms(requests.sparkSession, lateness) // (unit * 1000))
    rows = requests.withWatermark("event_time", lateness).select(
        _group("closing", F.col("user_id"), groups).alias("group"), F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user"),
        "ts_unit", "event_id", "event_time", "closing")
    return rows.groupBy("group").transformWithStateInPandas(
        LimiterProcessor(window, limit, unit * 1000, width), LIMITER_OUT, "append", "EventTime")


def limiter_stream(spark: SparkSession, sf_dir: str, window: int = K.LIMITER_WINDOW,
                   limit: int = K.LIMITER_LIMIT) -> DataFrame:
    """STR-4 over the events table. Its files are in no order of time, so the
    lateness is the table's spread and nobody's request is late; a live stream
    gives the disorder it expects instead."""
    from gavel.sources.bridges import LIMITER_UNIT as unit, SPARK, sql_for
    ev = stream_table(spark, sf_dir, "events")
    req = spark.sql(sql_for("b_limiter", SPARK, {"events": "{events}"}), events=ev).withColumn(
        "event_time", F.timestamp_seconds(F.col("ts_unit") * unit))
    lateness = _spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")
    return drain_in_order(req, lambda rows: limiter_over(rows, lateness, unit, window, limit), "limiter")


# ------------------------------------------------------------------ STR-6
def last_status(rows: DataFrame) -> DataFrame:
    """The last write per id by (file, ts, pos); null ids and statuses take no part."""
    order = F.struct("file", "ts", "pos")
    return (rows.where(F.col("instance_id").isNotNull() & F.col("status").isNotNull()).groupBy("instance_id")
            .agg(F.max_by(F.struct("status", "file", "ts", "pos"), order).alias("r")).select("instance_id", "r.*"))


def upsert_statuses(raw: DataFrame, path: str, buckets: int = 32) -> KeyedTable:
    """Last-write-wins status table under ``path``, maintained until the input is
    consumed. An epoch rewrites the buckets its ids fall in; a retried epoch
    writes the same, a restarted query goes on from its checkpoint."""
    spark = raw.sparkSession
    fields = [raw.schema[c] for c in ("instance_id", "status", "file", "ts", "pos")]
    table = KeyedTable(spark, f"{path}/table", "instance_id", StructType(fields), buckets)

    def upsert(batch: DataFrame, epoch: int):
        table.merge(batch, epoch, last_status)

    q = (raw.select(*[f.name for f in fields]).writeStream.foreachBatch(upsert)
         .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def status_upsert_stream(spark: SparkSession, sf_dir: str, table_path: str | None = None) -> DataFrame:
    """STR-6 over the events table."""
    from gavel.sources.bridges import SPARK, sql_for
    ev = stream_table(spark, sf_dir, "events")
    raw = spark.sql(sql_for("b_status_raw", SPARK, {"events": "{events}"}), events=ev)
    table = upsert_statuses(raw, table_path or _location(spark, "status_table"))
    return table.read().select("instance_id", "status")


# ------------------------------------------------------------------ STR-7
def first_seen(raw: DataFrame, path: str, key: str = "instance_id", buckets: int = 32) -> DataFrame:
    """Resume / skip-existing on a stream: every key leaves once, in the epoch that
    first has it, however late its repeats come. The keys seen so far are a
    bucketed table instead of state: an epoch reads the buckets its keys fall in,
    keeps the keys that are not there (anti join), writes them out under its number,
    then adds them to the table; a retried epoch finds the table as it was before it."""
    spark = raw.sparkSession
    schema = StructType([raw.schema[key]])
    table = KeyedTable(spark, f"{path}/seen", key, schema, buckets)

    def emit(batch: DataFrame, epoch: int):
        fresh = written(table.absent(batch, epoch), "first-seen")
        fresh.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        table.merge(fresh, epoch, lambda rows: rows.distinct())

    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/out/epoch=-1")
    q = (raw.select(key).writeStream.foreachBatch(emit).option("checkpointLocation", f"{path}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").select(key)


def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-7 over the events table."""
    from gavel.sources.bridges import SPARK, sql_for
    ev = stream_table(spark, sf_dir, "events")
    raw = spark.sql(sql_for("b_status_raw", SPARK, {"events": "{events}"}), events=ev)
    return first_seen(raw, _location(spark, "dedupe"))


# ------------------------------------------------------------------ STR-5
def sessions_over(events: DataFrame, as_op: Callable, lateness: str, groups: int = GROUPS) -> DataFrame:
    """Session log on a stream of (chain_id, at, tie, event_time, closing and
    whatever ``as_op`` reads); ``as_op(k, event)`` turns the k-th event of a chain
    into (op, session_id, user_id, new_session_id).

    Events wait in the state until the watermark passes their bucket of time and are
    applied in order of (at, tie); the state holds the waiting events, the
    number of applied ones and the live ids with their owners."""
    rows = events.withWatermark("event_time", lateness).select(
        _group("closing", F.col("chain_id"), groups).alias("group"), F.coalesce(F.col("chain_id").cast("string"), F.lit("")).alias("chain"),
        "at", "tie", "event", "event_time", "closing")
    return rows.groupBy("group").transformWithStateInPandas(
        SessionProcessor(as_op, _bucket_ms(events.sparkSession, lateness)), SESSION_OUT, "append", "EventTime")


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5 over the events table; the k-th event of a chain is its k-th op."""
    from gavel.sources.bridges import session_op
    ev = stream_table(spark, sf_dir, "events")
    at = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    chain = F.col("user_id") * 4 + F.col("event_id") % 4
    rows = ev.select(chain.alias("chain_id"), at.alias("at"), F.col("event_id").alias("tie"),
                     F.to_json(F.struct("event_type", "user_id", chain.alias("chain"))).alias("event"), F.timestamp_micros(at).alias("event_time"))
    lateness = _spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")
    return drain_in_order(rows, lambda r: sessions_over(r, session_op, lateness), "sessions")


def windowed_counts(rows: DataFrame, by: str, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Counts of ``by`` per tumbling (or sliding) window of ``event_time``, in
    append mode: a window is written once, when the watermark has passed its
    end, and leaves the state. Rows later than ``lateness`` are dropped and
    counted by the watermark. The closing marker opens a window that never ends."""
    counts = rows.withWatermark("event_time", lateness).groupBy(
        F.window("event_time", width, slide).alias("w"), by).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    start = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(w.start))")
    return counts.select(start.cast("string").alias("window_start"), by, "n")


def windowed_decision_counts_stream(spark: SparkSession, sf_dir: str, width: str = "30 days") -> DataFrame:
    """STR-2 over event time: decision counts per tumbling window of the ship
    date. The table's files are in no order of time, so the lateness is its
    spread; a live stream gives the disorder it expects."""
    from gavel.sources.bridges import SPARK, sql_for
    li = stream_table(spark, sf_dir, "lineitem")
    ev = spark.sql(sql_for("b_eval", SPARK, {"lineitem": "{lineitem}"}).replace(
        "SELECT 'li__'", "SELECT l_shipdate AS shipped, 'li__'", 1), lineitem=li)
    # the instant whose UTC wall clock is the ship date: windows do not depend on the session time zone
    rows = ev.select("final_decision", F.to_utc_timestamp(
        F.col("shipped").cast("timestamp"), F.current_timezone()).alias("event_time"))
    lateness = _spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate")
    return drain_in_order(rows, lambda r: windowed_counts(r, "final_decision", width, lateness), "decision_windows")
