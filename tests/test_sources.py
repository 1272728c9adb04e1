"""File sources on small fixtures written to scratch folders."""

import json

import os

import pytest
from pyspark.sql import functions as F

from gavel.operators import delta as D
from gavel.sources import files as S


def _write(d, name, text):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_prediction_shapes(spark, tmpdir_path):
    d = tmpdir_path
    _write(d, "arr/preds.json", json.dumps([{"instance_id": "a", "model_patch": "p1"}, "bare", {"task": "t", "model_patch": "p3"}]))
    _write(d, "map/preds.json", json.dumps({"x": {"model_patch": "px"}, "y": "py", "z": {"instance_id": "zz", "model_patch": "pz"}}))
    _write(d, "one/preds.json", "﻿" + json.dumps({"id": "solo", "model_patch": "ps"}))
    _write(d, "jl/preds.json", '{"instance_id": "l1", "model_patch": "a"}\n\n{}\n{"instance_id": "l1", "model_patch": "b"}\n')
    _write(d, "blank/preds.json", "   \n")
    got = {}
    for sub in ("arr", "map", "one", "jl", "blank"):
        rows = S.read_predictions(spark, os.path.join(d, sub, "preds.json")).orderBy("seq").collect()
        got[sub] = [(r.instance_id, r.model_patch) for r in rows]
    assert got["arr"] == [("a", "p1"), ("instance_2", "bare"), ("t", "p3")]
    assert sorted(got["map"]) == [("x", "px"), ("y", "py"), ("zz", "pz")]
    assert got["one"] == [("solo", "ps")]
    assert got["jl"] == [("l1", "a"), ("line_3", ""), ("l1", "b")]
    assert got["blank"] == []


def test_prediction_corner_shapes(spark):
    texts = {
        "line_list": '{"instance_id": "a", "model_patch": "1"}\n[{"id": "b"}, {"task": "0"}]\n{"m": {"task": "t", "model_patch": "x"}, "n": "y"}\n"bare"\nnull\n',
        "map_key_first": '{"a": {"task": "b", "model_patch": "p"}}', "null": "null", "zero": '[{"instance_id": 0, "task": "0"}, {"id": 0}, 7]',
        "pretty": '[\n {"instance_id": "p"},\n {"instance_id": "q"}\n]', "false_id": '{"instance_id": "", "id": false, "task_id": 12}',
    }
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    got = {k: [] for k in texts}
    for r in S.parse_prediction_texts(files).orderBy("file", "seq").collect():
        got[r.file].append((r.instance_id, r.model_patch))
    assert got == {
        "line_list": [("a", "1"), ("b", ""), ("0", ""), ("m", "x"), ("n", "y"), ("instance_unknown", "bare"), ("line_5", "")],
        "map_key_first": [("a", "p")], "null": [], "zero": [("0", ""), ("instance_2", ""), ("instance_3", "7")],
        "pretty": [("p", ""), ("q", "")], "false_id": [("12", "")],
    }
    bad = spark.createDataFrame([("f", '{"id": 1}\n{broken\n')], "file string, text string")
    with pytest.raises(Exception, match="malformed JSON on line 2"):
        S.parse_prediction_texts(bad).collect()


def test_statuses_last_write_wins(spark, tmpdir_path):
    d = tmpdir_path
    _write(d, "exit_statuses_1.yaml", "instances_by_exit_status:\n  Submitted: [a, b]\n  error: [c]\n")
    _write(d, "exit_statuses_2.yaml", "a: Success\nd: null\n")
    _write(d, "exit_statuses_3.yaml", "- not a mapping\n")
    _write(d, "exit_statuses_4.yaml", "a: [unclosed\n")
    rows = S.read_statuses(spark, os.path.join(d, "exit_statuses_*.yaml"))
    merged = {r.instance_id: r.status for r in S.merge_statuses(rows).collect()}
    assert merged == {"a": "Success", "b": "Submitted", "c": "error"}


def test_results_reports_trajectories(spark, tmpdir_path):
    d = tmpdir_path
    _write(d, "res/instance_results.jsonl",
           '{"instance_id": "a", "resolved": false}\n\n{"resolved": true}\n{"instance_id": "a", "resolved": true, '
           '"resolved_status": "RESOLVED"}\n')
    res = {r.instance_id: (r.resolved, r.resolved_status)
           for r in S.read_instance_results(spark, os.path.join(d, "res/instance_results.jsonl")).collect()}
    assert res == {"a": (True, "RESOLVED")}
    _write(d, "rep/a.json", json.dumps({"instance_id": "a", "scan_failed": False, "new_violations": ["X"]}))
    _write(d, "rep/b.json", "{not json")
    _write(d, "rep/c.json", json.dumps({"instance_id": "zz", "new_violations": "ONE"}))
    reps = {r.instance_id: (r.corrupt, r.new_violations) for r in S.read_reports(spark, os.path.join(d, "rep")).collect()}
    assert reps["a"] == (False, ["X"]) and reps["b"][0] is True
    assert reps["c"] == (False, ["ONE"])
    _write(d, "trajs/t/one.traj.json", json.dumps({"info": {"submission": "diff --git a/x b/x\n--- a/x\n+++ b/x\n  \n"}}))
    _write(d, "trajs/two.traj.json", json.dumps({"info": {"submission": "just prose"}}))
    tr = {r.instance_id: r.model_patch for r in S.read_trajectories(spark, os.path.join(d, "trajs")).collect()}
    assert tr == {"two": ""}  # the root level has files
    _write(d, "deep/t/one.traj.json", json.dumps({"info": {"submission": "diff --git a/x b/x\n--- a/x\n+++ b/x\n  \n"}}))
    _write(d, "deep/u/bad.traj.json", "{unreadable")
    tr = {r.instance_id: r.model_patch for r in S.read_trajectories(spark, os.path.join(d, "deep")).collect()}
    assert tr == {"one": "diff --git a/x b/x\n--- a/x\n+++ b/x\n"}


def test_ast_scan_and_delta(spark):
    tx = "db.save()\nwith db.transaction():\n    db.update()\nobj.delete()\n"
    once = "db.save()\nwith db.transaction():\n    db.update()\n"
    guard = "@app.get('/')\ndef h(r):\n    verify(r)\n    return current_user\n"
    cases = [
        ("import random\n", ["WEAK_RNG"], ["WEAK_RNG_USAGE"], None), ("from random import x", ["WEAK_RNG"], ["WEAK_RNG_USAGE"], None),
        ("import random\n", [], [], None), ("def (:\n", [], ["SYNTAX_ERROR_PREVENTS_SECURITY_SCAN"], None),
        ("token_limit = 4096\n", ["SECRETS"], None, "object of type 'int' has no len()"), ("token = 0\n", ["SECRETS"], [], None),
        ("password = 'abcde'", ["SECRETS"], ["HARDCODED_SECRETS"], None), ("password = 'my_ENV_x'", ["SECRETS"], [], None),
        (tx, ["NO_TRANSACTION"], ["NO_TRANSACTION_FOR_MULTI_WRITE"], None), (once, ["NO_TRANSACTION"], [], None),
        ("c.execute(f'{x}')", ["SQLI"], ["SQLI_FSTRING"], None), ("query('{}'.format(x))", ["SQLI"], ["SQLI_STRING_FORMAT"], None),
        ("exec('a' + b)", ["SQLI"], ["SQLI_STRING_CONCAT"], None), ("execute(x)", ["SQLI"], [], None),
        ("a.dangerouslySetInnerHTML(x)", ["XSS"], ["POTENTIAL_XSS"], None), (guard, ["MISSING_AUTH"], [], None),
        (guard.replace("verify", "read"), ["MISSING_AUTH"], ["MISSING_AUTH_CHECK"], None), (None, ["SQLI"], [], None),
    ]
    code = spark.createDataFrame([(i, c, r) for i, (c, r, _, _) in enumerate(cases)], "i int, code string, rules array<string>")
    got = {r.i: (r.findings, r.scan_error) for r in D.scan_files(code, "code", rules_col="rules").collect()}
    for i, (c, _, found, error) in enumerate(cases):
        assert got[i] == (found, error), c
    files = spark.createDataFrame([
        ("i1", "a.py", "x = 1\n", "import random\nx = 1\n"), ("i1", "b.md", None, "text"),
        ("i2", "c.py", "import random\n", "import random\n"), ("i3", "d.py", "x = 1\n", "def (:\n"),
    ], "instance_id string, path string, before string, after string")
    reps = {r.instance_id: (r.new_violations, r.scan_failed) for r in D.postapply_reports(files).collect()}
    assert reps["i1"] == (["WEAK_RNG_USAGE"], False)
    assert reps["i2"] == ([], False)
    assert reps["i3"] == (["SYNTAX_ERROR_PREVENTS_SECURITY_SCAN"], False)


def test_sinks(spark, tmpdir_path):
    from gavel.sinks import writers as W
    st = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", "ok")], "instance_id string, status string")
    kept, removed = W.delete_statuses(st, ["b", "zz"])
    assert sorted(r.instance_id for r in kept.collect()) == ["a", "c"]
    again, removed2 = W.delete_statuses(kept, ["b"])
    assert again.count() == 2 and removed2.count() == 0
    same, would = W.delete_statuses(st, ["a"], dry_run=True)
    assert same.count() == 3 and would.count() == 1
    W.write_jsonl(st.withColumn("seq", F.monotonically_increasing_id()), os.path.join(tmpdir_path, "out"))
    back = spark.read.json(os.path.join(tmpdir_path, "out"))
    assert back.count() == 3
    W.write_csv(st, os.path.join(tmpdir_path, "csv"))
    assert spark.read.option("header", "true").csv(os.path.join(tmpdir_path, "csv")).count() == 3


def test_keyed_table_state_and_record_pick(spark, tmpdir_path):
    from gavel.operators.cards import pick_record
    from gavel.sinks import writers as W
    state = spark.createDataFrame([("a", "failed", 1), ("b", "done", 2)], "key string, status string, seq long")
    now = W.upsert_state(state, spark.createDataFrame([("a", "done", 3), ("c", "done", 4), ("b", "failed", 0)], state.schema))
    assert sorted((r.key, r.status, r.seq) for r in now.collect()) == [("a", "done", 3), ("b", "done", 2), ("c", "done", 4)]
    W.write_table(now, os.path.join(tmpdir_path, "t"), key="key", buckets=3)
    assert spark.read.parquet(os.path.join(tmpdir_path, "t")).count() == 3
    assert pick_record(now.withColumnRenamed("key", "task"), "c").first().seq == 4
    assert pick_record(now.withColumnRenamed("key", "task")).first().task == "b"


def test_stream_to_parquet(spark, tmpdir_path):
    from gavel.streaming import jobs as J
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([("a", "diff --git a/x b/x\n")], "instance_id string, model_patch string").write.parquet(src)
    stream = spark.readStream.schema("instance_id string, model_patch string").parquet(src)
    empty = spark.createDataFrame([], "instance_id string, status string")
    res = spark.createDataFrame([], "instance_id string, resolved boolean, resolved_status string")
    ev = J.governed_eval_stream(spark, stream, empty, res, None, model_id="m")
    out = os.path.join(tmpdir_path, "out")
    q = J.start_to_parquet(ev.drop("artifacts"), "t-" + os.path.basename(tmpdir_path), out, processing_time=None)
    q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0].final_decision == "ABSTAIN" and rows[0].security_scan_failed


def test_scalar_report_context_compare(spark, tmpdir_path):
    d = tmpdir_path
    _write(d, "sc/preds.json", json.dumps("diff --git a/x b/x"))
    rows = S.read_predictions(spark, os.path.join(d, "sc/preds.json")).collect()
    assert [(r.instance_id, r.model_patch) for r in rows] == [("instance_unknown", "diff --git a/x b/x")]
    _write(d, "ev/r.run1.json", json.dumps({
        "report": {"a": {"resolved": True}, "b": {"resolved": True, "patch_successfully_applied": False}},
        "results": [{"instance_id": "a", "resolved": False}, {"task": "c", "resolved": True}, "junk"],
    }))
    _write(d, "ev2/r.run1.json", json.dumps({"instance_id": "solo", "resolved": True}))
    rep = {r.instance_id: (r.resolved, r.patch_successfully_applied)
           for r in S.read_evaluator_report(spark, os.path.join(d, "ev/r.run1.json")).collect()}
    assert rep == {"a": (False, None), "b": (True, False), "c": (True, None)}
    solo = S.read_evaluator_report(spark, os.path.join(d, "ev2/r.run1.json")).collect()
    assert [(r.instance_id, r.resolved) for r in solo] == [("solo", True)]
    from gavel.operators.ordered import pack_context, rows_equal
    files = spark.createDataFrame([
        ("i", 1, "pkg/b.py", "changed", "B"), ("i", 2, "pkg/a.py", "changed", "A"), ("i", 3, "d.md", "changed", "D"),
        ("i", 4, "tests/test_z.py", "test", "Z"), ("i", 5, "tests/test_y.py", "test", "Y"),
        ("j", 1, "e.py", "explicit", "E"), ("j", 2, "c.py", "changed", "C"),
    ], "instance_id string, pos long, path string, kind string, content string")
    ctx = {r.instance_id: r.context for r in pack_context(files).collect()}
    assert ctx["i"] == ("=== pkg/b.py ===\nB\n\n=== pkg/a.py ===\nA\n\n=== tests/test_y.py (tests) ===\nY\n\n"
                        "=== tests/test_z.py (tests) ===\nZ\n")
    assert ctx["j"] == "=== e.py ===\nE\n"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([("y", 2), ("z", 3)], "v string, k int")
    cmp = rows_equal(a, b).first()
    assert (cmp.only_left, cmp.only_right, cmp.left_rows, cmp.right_rows) == (1, 1, 2, 2)


def test_jsonl_modes(spark, tmpdir_path):
    p = _write(tmpdir_path, "r.jsonl", '{"final_decision": "OK"}\n{not json\n\n{"final_decision": "VETO"}\n')
    schema = "final_decision string"
    keep = S.read_jsonl(spark, p, schema, "PERMISSIVE").orderBy("line").collect()
    assert [(r.line, r._corrupt_record is not None) for r in keep] == [(1, False), (2, True), (4, False)]
    drop = S.read_jsonl(spark, p, schema, "DROPMALFORMED").collect()
    assert sorted(r.final_decision for r in drop) == ["OK", "VETO"]


def test_listings_and_pickers(spark, tmpdir_path):
    import time as _t
    d = tmpdir_path
    old = _write(d, "logs/run_evaluation/r1/model/inst1/run_instance.log", "resolved: False")
    new = _write(d, "logs/run_evaluation/r2/model/inst1/run_instance.log", ">>>>> Patch Apply Failed")
    _write(d, "logs/run_evaluation/r2/model/inst2/run_instance.log", "resolved: True")
    os.utime(old, (_t.time() - 100, _t.time() - 100))
    logs = {r.instance_id: r.log_text for r in S.read_eval_logs(spark, os.path.join(d, "logs")).collect()}
    assert logs == {"inst1": ">>>>> Patch Apply Failed", "inst2": "resolved: True"}
    a = _write(d, "out/a.run1.json", "{}")
    _write(d, "out/b.run1.json", "{}")
    os.utime(a, (_t.time() + 100, _t.time() + 100))
    assert S.newest_report_path(spark, os.path.join(d, "out"), "run1").first().path.endswith("a.run1.json")
    _write(d, "msa/trajs/i1.traj.json", "{}")
    _write(d, "msa/trajectories/i1.traj.json", "{}")
    _write(d, "msa/logs/i1.txt", "x")
    _write(d, "msa/preds_filled.json", "[]")
    _write(d, "msa/preds.json", "[]")
    listing = S.list_files(spark, os.path.join(d, "msa"))
    arts = {(r.instance_id, r.kind): r.path for r in S.discover_artifacts(
        listing, os.path.join(d, "msa"), {"traj": ["trajs/{id}.traj.json", "trajectories/{id}.traj.json"],
                                           "log": ["logs/{id}.log", "logs/{id}.txt"]}).collect()}
    assert arts == {("i1", "traj"): "trajs/i1.traj.json", ("i1", "log"): "logs/i1.txt"}
    pick = S.choose_prediction_file(listing).collect()
    assert len(pick) == 1 and pick[0].path.endswith("preds_filled.json")
    cat = S.task_catalogue(spark).collect()
    assert len(cat) == 11 and cat[2].security_rules == ["SQLI"]


def test_distributed_jsonl_line_numbers(spark, tmpdir_path):
    lines = []
    for i in range(1, 201):
        lines.append("" if i % 17 == 0 else ("{}" if i % 23 == 0 else json.dumps({"instance_id": f"i{i}", "model_patch": "p"})))
    p = _write(tmpdir_path, "big/preds.jsonl", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # many splits of one file
    try:
        nl = {r.line: r.value for r in S.numbered_lines(spark, p).collect()}
        rows = {r.seq.line: r.instance_id for r in S.read_predictions_jsonl(spark, p).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert nl == {i: lines[i - 1] for i in range(1, 201)}
    expect = {i: (f"line_{i}" if i % 23 == 0 else f"i{i}") for i in range(1, 201) if i % 17 != 0}
    assert rows == expect


def test_newest_logs_open_only_what_they_read(spark, tmpdir_path):
    """Names with blanks and pattern characters are names; an older log that
    cannot be read is listed, never opened."""
    import shutil
    d = tmpdir_path
    for k, inst in enumerate(["plain", "a b+c", "x[1]{2}*", "p%20q"]):
        old = _write(d, f"logs/r1/{inst}/run_instance.log", "old")
        os.utime(old, (1000, 1000))
        _write(d, f"logs/r2/{inst}/run_instance.log", f"new {k}\nline")
    listing = S.written(S.newest_per_key(S.list_files(spark, f"{d}/logs", "run_instance.log"), S.EVAL_LOG_KEY), "test-newest")
    shutil.rmtree(f"{d}/logs/r1")  # gone after the choice: a reader of every log would fail
    assert sorted(r.text for r in S.read_chosen(spark, listing).collect()) == [f"new {k}\nline" for k in range(4)]
    logs = {r.instance_id: r.log_text for r in S.read_eval_logs(spark, f"{d}/logs").collect()}
    assert logs == {"plain": "new 0\nline", "a b+c": "new 1\nline", "x[1]{2}*": "new 2\nline", "p%20q": "new 3\nline"}
    assert S.read_chosen(spark, listing.limit(0)).count() == 0


def test_evaluator_reports_in_one_scan(spark):
    """Sections in their order, lists and maps, the lone object, unreadable texts."""
    texts = {
        "all": {"instances": [{"id": "a", "resolved": True}], "report": {"a": {"resolved": False}, "b": {"resolved": True}, "c": 5},
                "results": [{"task": "b", "resolved": False}, "junk", {"resolved": True}]},
        "top": [{"task_id": "t", "resolved": True, "patch_successfully_applied": False}, 7],
        "lone": {"instance_id": "solo", "resolved": True}, "empty": {"instance_id": ""}, "kept": {"instance_id": "x", "report": {"y": {}}}}
    files = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [("bad", "{"), ("none", None), ("str", '"x"')],
                                  "file string, text string")
    rows = S.parse_evaluator_reports(files)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan
    got = sorted((r.file, r.instance_id, r.resolved, r.patch_successfully_applied) for r in rows.collect())
    assert got == [("all", "a", True, None), ("all", "b", False, None), ("kept", "y", None, None), ("lone", "solo", True, None),
                   ("top", "t", True, False)]
