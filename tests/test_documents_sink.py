"""JSON documents written by many tasks equal the json module's own output."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gavel.sinks import documents as D
from gavel.sources import files as S


def _rows(n, seed=3):
    rnd = random.Random(seed)
    return [(f"i{k}", "".join(rnd.choice('ab"\\,[]{}\n é€') for _ in range(rnd.randint(0, 60))) if k % 9 else None, k) for k in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("n", [0, 1, 500])
def test_array_equals_the_json_module(spark, tmpdir_path, n, indent):
    rows = _rows(n)
    df = spark.createDataFrame(random.Random(1).sample(rows, n), "instance_id string, model_patch string, _seq long")
    path = os.path.join(tmpdir_path, "preds.json")
    D.write_document(df.repartition(5), path, ["_seq"], indent=indent, block=700)
    expected = [{"instance_id": i, "model_patch": p} for i, p, _ in rows]
    with open(path, encoding="utf-8") as f:
        assert f.read() == json.dumps(expected, indent=indent)
    assert os.listdir(tmpdir_path) == ["preds.json"]


def test_mapping_keeps_the_last_of_equal_keys(spark, tmpdir_path):
    rows = [(f"k{k % 40}", f"p{k}", k) for k in range(100)]
    df = spark.createDataFrame(rows, "instance_id string, model_patch string, _seq long")
    path = os.path.join(tmpdir_path, "map.json")
    D.write_document(df, path, ["_seq"], "mapping", "instance_id", block=100)
    expected = {}
    for i, p, _ in rows:
        expected[i] = {"instance_id": i, "model_patch": p}
    with open(path, encoding="utf-8") as f:
        assert f.read() == json.dumps(expected)


def test_selection_outputs_and_a_second_write(spark, tmpdir_path):
    best = spark.createDataFrame([("b", None, 0.5, ["v"]), ("a", "diff", None, [])],
                                 "instance_id string, patch string, cri double, v array<string>")
    for _ in range(2):
        D.write_selection(best, tmpdir_path)
    with open(f"{tmpdir_path}/preds.json", encoding="utf-8") as f:
        assert f.read() == json.dumps([{"instance_id": "a", "model_patch": "diff"}, {"instance_id": "b", "model_patch": ""}], indent=2)
    with open(f"{tmpdir_path}/selection_report.jsonl", encoding="utf-8") as f:
        assert f.read() == ('{"instance_id": "a", "patch": "diff", "cri": null, "v": []}\n'
                            '{"instance_id": "b", "patch": null, "cri": 0.5, "v": ["v"]}\n')
    got = S.read_predictions_json(spark, f"{tmpdir_path}/preds.json").select("instance_id", "model_patch").collect()
    assert sorted(map(tuple, got)) == [("a", "diff"), ("b", "")]


def test_a_failed_write_leaves_the_old_document(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "preds.json")
    df = spark.createDataFrame([("a", 1)], "instance_id string, _seq long")
    D.write_document(df, path, ["_seq"])
    D.DocumentWriter({"path": path, "attempt": "x", "size": "5", "opening": "[", "closing": "]"}).abort([])
    short = D.DocumentWriter({"path": path, "attempt": "x", "size": "5", "opening": "[", "closing": "]"})
    with pytest.raises(RuntimeError):
        short.commit([D.Placed(4), None])
    with open(path, encoding="utf-8") as f:
        assert f.read() == '[{"instance_id": "a"}]'
