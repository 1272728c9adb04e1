"""Large JSON arrays and maps in byte ranges equal the whole-file reader."""

import json
import os
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from gavel.sources import files as S


@pytest.fixture()
def tiny_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "16"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _patch(rng):
    parts = ["+a, b", "\\", '"', '\\"', "{[", "]}", ",", "\n", "caf\u00e9 \U0001f600", "}", "[,", "\t", "x" * 50]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


def _array(rng, n):
    return [rng.choice([
        {"instance_id": f"i{k}", "model_patch": _patch(rng), "more": {"a": [1, [2, {"b,": "]"}]], "c": None}},
        {"task": f"t{k}", "model_patch": _patch(rng), "tau_step": k, "provider": "p,q"}, _patch(rng), None, 7, {"model_patch": None}, [1, [2]]])
        for k in range(n)]


DOCUMENTS = {
    "array": lambda rng: _array(rng, 60),
    "map": lambda rng: {f"id {k}, {_patch(rng)}": v for k, v in enumerate(_array(rng, 60))} | {"": {"model_patch": "d"}},
    "single": lambda rng: {"model_patch": _patch(rng) * 20, "task_id": "one", "x": {"y": [1, 2]}},
    "empty-array": lambda rng: [], "empty-map": lambda rng: {}, "one": lambda rng: ["p, q"], "nested": lambda rng: [[], {}, [[]], "]"],
}


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_byte_ranges_equal_the_whole_file(spark, tmpdir_path, tiny_ranges, name):
    rng = random.Random(name)
    doc = DOCUMENTS[name](rng)
    for style, text in (("plain", json.dumps(doc)), ("wide", "\ufeff \n" + json.dumps(doc, indent=1, ensure_ascii=False) + " \n\n"),
                        ("dense", json.dumps(doc, separators=(",", ":"), ensure_ascii=False))):
        path = os.path.join(tmpdir_path, f"{style}.json")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        key = lambda r: repr(r)
        want = sorted((tuple(r) for r in S.read_predictions(spark, path).collect()), key=key)
        got = S.read_predictions_json(spark, path)
        assert sorted((tuple(r) for r in got.collect()), key=key) == want, style
        if name == "array":
            assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() > 20


def test_equal_keys_and_several_files(spark, tmpdir_path, tiny_ranges):
    for i, text in enumerate(('{"a": "1", "b": "2", "a": "3"}', '["x", "y"]')):
        with open(os.path.join(tmpdir_path, f"{i}.json"), "w") as f:
            f.write(text)
    got = {(os.path.basename(r.file), r.instance_id, r.model_patch) for r in S.read_predictions_json(spark, tmpdir_path).collect()}
    assert got == {("0.json", "a", "3"), ("0.json", "b", "2"), ("1.json", "instance_1", "x"), ("1.json", "instance_2", "y")}


@pytest.mark.parametrize("text", ['[1, 2', '{"a": 1}\n{"b": 2}', '[1,, 2]', '7', '[{"a": }]'])
def test_malformed_documents_fail(spark, tmpdir_path, text):
    path = os.path.join(tmpdir_path, "bad.json")
    with open(path, "w") as f:
        f.write(text)
    with pytest.raises((PySparkException, Py4JJavaError), match="malformed JSON|neither a JSON"):
        S.read_predictions_json(spark, path).collect()


@pytest.mark.parametrize("name", ["array", "map", "single"])
def test_short_spans_equal_the_whole_file(spark, tmpdir_path, tiny_ranges, monkeypatch, name):
    """A byte range is worked off in spans of two pieces."""
    monkeypatch.setattr(S, "SPAN_BITS", 1)
    path = os.path.join(tmpdir_path, "doc.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(DOCUMENTS[name](random.Random(5)), f)
    got = sorted(map(repr, S.read_predictions_json(spark, path).collect()))
    assert got == sorted(map(repr, S.read_predictions(spark, path).collect()))


def test_members_of_a_file_do_not_meet_in_one_task(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "map.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({f"k{i}": f"p{i}, q" for i in range(50)}, f)
    plan = S.read_predictions_json(spark, path)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("LeftAnti" in line or "LeftSemi" in line)]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_tasks_follow_the_bytes(spark, tmpdir_path, monkeypatch):
    path = os.path.join(tmpdir_path, "a.json")
    with open(path, "w") as f:
        json.dump(["x" * 50] * 100, f)
    least = spark.sparkContext.defaultParallelism
    assert S._tasks(spark, path) == least
    monkeypatch.setattr(S, "TASK_BYTES", 100)
    assert S._tasks(spark, path) == -(-os.path.getsize(path) // 100) > least
    assert len(S.read_predictions_json(spark, path).collect()) == 100
