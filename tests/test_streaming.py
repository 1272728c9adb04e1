"""Ordered streams: any split into files and micro-batches equals the batch
result; late rows are dropped and counted; state leaves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gavel.operators import tasks as B
from gavel.sources.bridges import bridge, session_op
from gavel.streaming import jobs as J
from test_tasks import brute_limiter

REQUESTS = "event_id long, user_id long, ts_unit long"


def _stream(spark, folder, parts, schema):
    """One file a part, one file a micro-batch, in the given order."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.startswith("part-") and not os.path.exists(f"{folder}/.{f}.seen"):
                os.utime(f"{folder}/{f}", (1000 + 10 * k, 1000 + 10 * k))
                open(f"{folder}/.{f}.seen", "w").close()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _limited(spark, folder, parts, lateness):
    rows = _stream(spark, folder, parts, REQUESTS).withColumn("event_time", F.timestamp_seconds("ts_unit"))
    return {r.event_id: r.allowed for r in J.drain_in_order(rows, lambda r: J.limiter_over(r, lateness), "limiter-test").collect()}


@pytest.fixture()
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "20")
    yield
    spark.conf.set(key, old)


def test_limiter_stream_takes_files_in_any_order(spark, tmpdir_path, small_batches):
    rnd = random.Random(4)
    events = [(i, rnd.randint(0, 2), 50 + i // 3 + rnd.randint(0, 4)) for i in range(300)]
    shuffled = rnd.sample(events, len(events))
    for name, parts in (("newest-first", [events[::-1][:150], events[::-1][150:]]), ("mixed", [shuffled[:60], shuffled[60:200], shuffled[200:]])):
        assert _limited(spark, f"{tmpdir_path}/{name}", parts, "1 day") == brute_limiter(events), name


def test_limiter_stream_drops_only_what_is_later_than_allowed(spark, tmpdir_path, small_batches):
    """Disorder of at most 20 seconds with a lateness of 30 is exact; a request
    100 seconds late takes no part."""
    rnd = random.Random(6)
    events = sorted(((i, i % 2, 1000 + i // 2) for i in range(400)), key=lambda e: e[2] + rnd.randint(0, 20))
    late = (999, 0, 1000)
    got = _limited(spark, f"{tmpdir_path}/in", [events[:100], events[100:250], events[250:] + [late]], "30 seconds")
    assert got == brute_limiter(events)


def test_limiter_denies_surplus_of_a_unit_at_once(spark, tmpdir_path, small_batches):
    events = [(i, 1, 5) for i in range(60)][::-1]
    assert _limited(spark, f"{tmpdir_path}/in", [events[:30], events[30:]], "1 day") == brute_limiter(events)


def test_session_stream_takes_files_in_any_order(spark, tmpdir_path, small_batches):
    rnd = random.Random(9)
    kinds = ["view", "click", "purchase", "signup", "other"]
    rows = [(i % 3, 1_000_000 * (50 + i // 2) + rnd.choice([0, 0, 250]), i, f'{{"event_type":"{rnd.choice(kinds)}","user_id":{i % 3},"chain":{i % 3}}}')
            for i in range(120)]
    schema = "chain_id long, at long, tie long, event string"
    by = {c: sorted(r[1:] for r in rows if r[0] == c) for c in range(3)}
    import json
    log = [(c, k, *session_op(k, json.loads(e))) for c, es in by.items() for k, (_, _, e) in enumerate(es, 1)]
    batch = spark.createDataFrame(log, "chain_id long, seq long, op string, session_id string, user_id string, new_session_id string")
    want = sorted(map(tuple, B.session_ops(batch).collect()), key=repr)
    mixed = rnd.sample(rows, len(rows))
    stream = _stream(spark, f"{tmpdir_path}/in", [mixed[:50], mixed[50:]], schema).withColumn("event_time", F.timestamp_micros("at"))
    got = J.drain_in_order(stream, lambda r: J.sessions_over(r, session_op, "1 day"), "sessions-test")
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_session_op_equals_the_bridge(spark):
    sf = "/root/testdata/sf0.001"
    log = bridge(spark, sf, "b_session_log").collect()
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id * 4 + event_id % 4 AS chain", "event_type", "user_id", "ts", "event_id").orderBy("chain", "ts", "event_id").collect()
    seen, want = {}, []
    for e in events:
        k = seen[e.chain] = seen.get(e.chain, 0) + 1
        want.append((e.chain, k, *session_op(k, e.asDict())))
    assert sorted((r.chain_id, r.seq, r.op, r.session_id, r.user_id, r.new_session_id) for r in log) == sorted(want) or \
        sorted(map(repr, ((r.chain_id, r.seq, r.op, r.session_id, r.user_id, r.new_session_id) for r in log))) == sorted(map(repr, want))


@pytest.mark.parametrize("slide", [None, "5 seconds"])
def test_windows_leave_the_state_and_equal_the_batch(spark, tmpdir_path, slide):
    rnd = random.Random(3)
    rows = sorted(((1000 + i // 4, rnd.choice("ab")) for i in range(800)), key=lambda r: r[0] + rnd.randint(0, 8))
    schema = "t long, kind string"
    parts = [rows[:200], rows[200:500], rows[500:] + [(900, "a")]]  # the last row is too late
    stream = _stream(spark, f"{tmpdir_path}/in", parts, schema).withColumn("event_time", F.timestamp_seconds("t"))
    progress = []
    got = J.drain_in_order(stream, lambda r: J.windowed_counts(r, "kind", "10 seconds", "20 seconds", slide), "windows-test", progress)
    want = spark.createDataFrame(rows, schema).groupBy(
        F.window(F.timestamp_seconds("t"), "10 seconds", slide).alias("w"), "kind").count().select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss"), "kind", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for o in state) == (1 if slide is None else 2)
    total = [o["numRowsTotal"] for o in state]
    assert max(total) < len(want.collect()) and total[-1] <= 2  # only the closing marker's windows are left


def _timers(progress):
    return sum(int(o["customMetrics"].get("numRegisteredTimers", 0)) for p in progress for o in p["stateOperators"])


def test_state_calls_grow_with_groups_not_with_rows(spark, tmpdir_path, small_batches):
    rnd = random.Random(12)
    events = [(i, i % 400, 5000 + rnd.randint(0, 900)) for i in range(2000)]
    rows = _stream(spark, f"{tmpdir_path}/limiter", [events[:900], events[900:]], REQUESTS).withColumn("event_time", F.timestamp_seconds("ts_unit"))
    progress = []
    got = J.drain_in_order(rows, lambda r: J.limiter_over(r, "901 seconds", groups=4), "limiter-test", progress)
    assert {r.event_id: r.allowed for r in got.collect()} == brute_limiter(events)
    assert 4 <= _timers(progress) <= 4 * 18
    log = [(i % 300, 1_000_000 * (5000 + rnd.randint(0, 900)), i, f'{{"event_type":"view","user_id":1,"chain":{i % 300}}}') for i in range(1500)]
    rows = _stream(spark, f"{tmpdir_path}/sessions", [log[:700], log[700:]], "chain_id long, at long, tie long, event string").withColumn(
        "event_time", F.timestamp_micros("at"))
    progress = []
    got = J.drain_in_order(rows, lambda r: J.sessions_over(r, session_op, "901 seconds", groups=4), "sessions-test", progress).collect()
    assert sorted((r.chain_id, r.seq) for r in got) == sorted((c, k) for c in range(300) for k in range(1, 6))
    assert all(r.owner == "u1" and r.live_after for r in got) and 4 <= _timers(progress) <= 4 * 18


def test_allowed_times_count_over_buckets_and_leave_the_state(spark, tmpdir_path, small_batches):
    """Requests of one user in many epochs, with a watermark that moves between them."""
    rnd = random.Random(2)
    events = sorted(((i, i % 2, 1000 + i // 3) for i in range(900)), key=lambda e: e[2] + rnd.randint(0, 8))
    parts = [events[k:k + 150] for k in range(0, 900, 150)]
    rows = _stream(spark, f"{tmpdir_path}/in", parts, REQUESTS).withColumn("event_time", F.timestamp_seconds("ts_unit"))
    progress = []
    got = J.drain_in_order(rows, lambda r: J.limiter_over(r, "16 seconds"), "limiter-test", progress)
    assert {r.event_id: r.allowed for r in got.collect()} == brute_limiter(events)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1] == 0


def test_session_chains_go_on_over_epochs(spark, tmpdir_path, small_batches):
    import json
    rnd = random.Random(5)
    kinds = ["view", "click", "purchase", "signup", "other"]
    rows = [(i % 7, 1_000_000 * (1000 + i // 3), i, f'{{"event_type":"{rnd.choice(kinds)}","user_id":{i % 7},"chain":{i % 7}}}') for i in range(600)]
    by = {c: [r[1:] for r in rows if r[0] == c] for c in range(7)}
    log = [(c, k, *session_op(k, json.loads(e))) for c, es in by.items() for k, (_, _, e) in enumerate(es, 1)]
    want = B.session_ops(spark.createDataFrame(log, "chain_id long, seq long, op string, session_id string, user_id string, new_session_id string"))
    mixed = sorted(rows, key=lambda r: r[1] + rnd.randint(0, 8_000_000))
    stream = _stream(spark, f"{tmpdir_path}/in", [mixed[k:k + 150] for k in range(0, 600, 150)],
                     "chain_id long, at long, tie long, event string").withColumn("event_time", F.timestamp_micros("at"))
    got = J.drain_in_order(stream, lambda r: J.sessions_over(r, session_op, "16 seconds"), "sessions-test")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
