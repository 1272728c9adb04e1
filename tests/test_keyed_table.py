"""Bucketed keyed tables: touched buckets alone are rewritten, retried epochs
change nothing, streams over several files equal the batch result."""

import os

from gavel.sinks.keyed import KeyedTable
from gavel.streaming import jobs as J

ROWS = "instance_id string, status string, file string, ts long, pos long"


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/rows") for f in names if f.startswith("part-")}


def _state(table):
    return {r.instance_id: (r.status, r.ts) for r in table.read().collect()}


def test_an_epoch_writes_only_its_buckets(spark, tmpdir_path):
    schema = spark.createDataFrame([], ROWS).schema
    path = f"{tmpdir_path}/t"
    table = KeyedTable(spark, path, "instance_id", schema, 16)
    assert table.read().count() == 0
    model = {}
    everything = [(f"i{k}", "s0", "f", 5, k) for k in range(200)]
    epochs = [everything, [("i3", "s1", "f", 6, 0), ("i3", "old", "f", 1, 0)], [("i3", "s2", "f", 7, 0), ("new", "n", "f", 1, 0)],
              [], [(None, "x", "f", 9, 0), ("i4", None, "f", 9, 0)], [("i5", "late", "a", 1, 0)]]
    for epoch, rows in enumerate(epochs):
        for attempt in range(2):  # the second is a retry
            before = _files(path)
            touched = table.merge(spark.createDataFrame(rows, ROWS), epoch, J.last_status)
            assert len(touched) <= len({r[0] for r in rows})
            written = {f.split("/bucket=")[1].split("/")[0] for f in _files(path) - before}
            assert written <= {str(b) for b in touched}
        for i, s, f, ts, pos in rows:
            if i is not None and s is not None and (i not in model or (f, ts, pos) >= model[i][0]):
                model[i] = ((f, ts, pos), s)
        table = KeyedTable(spark, path, "instance_id", schema)  # as after a restart
        assert table.buckets == 16
        assert _state(table) == {i: (s, o[1]) for i, (o, s) in model.items()}
    assert len({f.split("/part-")[0] for f in _files(path)}) <= 2 * 16  # two versions a bucket


def test_a_broken_epoch_leaves_the_table_as_it_was(spark, tmpdir_path):
    schema = spark.createDataFrame([], ROWS).schema
    table = KeyedTable(spark, f"{tmpdir_path}/t", "instance_id", schema, 4)
    table.merge(spark.createDataFrame([("a", "1", "f", 1, 0), ("b", "1", "f", 1, 0)], ROWS), 0, J.last_status)
    commit, table._commit = table._commit, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    change = spark.createDataFrame([("a", "2", "f", 2, 0)], ROWS)
    try:
        table.merge(change, 1, J.last_status)
    except OSError:
        pass
    assert _state(table) == {"a": ("1", 1), "b": ("1", 1)}
    table._commit = commit
    table.merge(change, 1, J.last_status)
    assert _state(table) == {"a": ("2", 2), "b": ("1", 1)}


def test_streams_over_several_files(spark, tmpdir_path):
    parts = [[(f"i{(k * 7 + p) % 23}", f"s{k}-{p}", f"f{p % 2}", k, p) for k in range(30)] for p in range(4)]
    for p, rows in enumerate(parts):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/in")
    whole = spark.read.parquet(f"{tmpdir_path}/in")

    def stream():
        return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_path}/in")

    table = J.upsert_statuses(stream(), f"{tmpdir_path}/status", buckets=4)
    expected = {r.instance_id: (r.status, r.ts) for r in J.last_status(whole).collect()}
    assert _state(table) == expected
    seen = J.first_seen(stream(), f"{tmpdir_path}/first", buckets=4)
    assert sorted(r.instance_id for r in seen.collect()) == sorted(r.instance_id for r in whole.select("instance_id").distinct().collect())
    # more input, the same checkpoints: only new ids leave
    spark.createDataFrame([("i1", "z", "f9", 99, 0), ("fresh", "z", "f9", 99, 0)], ROWS).coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/in")
    assert _state(J.upsert_statuses(stream(), f"{tmpdir_path}/status")) == expected | {"i1": ("z", 99), "fresh": ("z", 99)}
    again = [r.instance_id for r in J.first_seen(stream(), f"{tmpdir_path}/first").collect()]
    assert len(again) == len(set(again)) == 24 and "fresh" in again
