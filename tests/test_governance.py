"""Governed evaluation cases, following the governed tool's code paths."""

import pytest

from gavel.operators.governance import governed_eval

DIFF_PY = ("diff --git a/src/m.py b/src/m.py\n--- a/src/m.py\n+++ b/src/m.py\n@@ -0,0 +1,2 @@\n"
           "+import os\n+x = 1\n")
DIFF_SECRET = ("diff --git a/src/m.py b/src/m.py\n--- a/src/m.py\n+++ b/src/m.py\n@@ -0,0 +1,1 @@\n"
               "+password = \"hunter22\"\n")
DIFF_BARE = "diff --git a/x b/x\n"
DOCKER = "Error: docker container start timed out after 120 seconds"
PHRASE = "Command timed out after 300 seconds"


@pytest.fixture(scope="module")
def tables(spark):
    preds = spark.createDataFrame([
        ("a", DIFF_PY), ("b", DIFF_PY), ("c", DIFF_PY), ("d", DIFF_PY), ("e", DOCKER), ("f", PHRASE),
        ("g", PHRASE), ("h", ""), ("i", DIFF_SECRET), ("j", DIFF_BARE), ("k", DIFF_PY),
    ], "instance_id string, model_patch string")
    statuses = spark.createDataFrame([("c", "Success"), ("k", "submitted")], "instance_id string, status string")
    results = spark.createDataFrame([
        ("c", True, "RESOLVED"), ("e", True, "RESOLVED"), ("g", False, "UNRESOLVED"), ("k", None, "resolved"),
        ("d", True, None),
    ], "instance_id string, resolved boolean, resolved_status string")
    reports = spark.createDataFrame([
        ("a", None, False, None, None, ["WEAK_RNG_USAGE"], False),
        ("b", "postapply_fullfile_delta_v1", True, None, None, [], False),
        ("c", None, False, True, None, [], False),
        ("d", None, False, None, None, ["[info] POTENTIAL_XSS"], False),
        ("k", None, False, None, None, None, True),
    ], "instance_id string, scan_scope string, scan_failed boolean, scan_ok boolean, scan_error string, "
       "new_violations array<string>, corrupt boolean")
    return preds, statuses, results, reports


def _rows(df):
    return {r.task: r for r in df.collect()}


def test_with_reports_and_fallback(spark, tables):
    preds, statuses, results, reports = tables
    r = _rows(governed_eval(preds, statuses, results, reports, model_id="m", allow_diff_fallback=True))
    assert r["a"].final_decision == "VETO" and r["a"].security_violations == ["[high] WEAK_RNG_USAGE"]
    assert r["a"].decision_reason == "sad_veto"
    assert r["b"].security_scan_failed and r["b"].final_decision == "ABSTAIN"
    assert r["b"].security_scan_error == "security scan marked as failed" and r["b"].cri == 0.0
    assert r["c"].final_decision == "OK" and r["c"].cri == 1.0 and r["c"].eval_status == "resolved"
    assert r["d"].final_decision == "OK" and r["d"].cri == pytest.approx(0.95) and r["d"].decision_reason == "ok"
    assert r["e"].eval_status == "infra_error" and r["e"].resolved is False and r["e"].final_decision == "ABSTAIN"
    assert r["e"].security_scan_scope == "skipped_infra_timeout_before_patch"
    assert r["f"].eval_status == "infra_timeout_before_patch" and r["f"].decision_reason == "not_resolved"
    assert r["g"].eval_status == "unresolved" and not r["g"].infra_timeout_before_patch
    assert r["h"].patch == "\n" and r["h"].security_scan_failed and r["h"].final_decision == "ABSTAIN"
    assert r["i"].sad_flag and r["i"].final_decision == "VETO"
    assert r["j"].security_scan_failed  # a bare header has no Python content
    assert r["k"].security_report_found and r["k"].security_scan_failed
    assert r["k"].security_scan_error == "unreadable security report"
    assert r["k"].resolved is True and r["k"].resolved_status == "RESOLVED"
    for row in r.values():
        assert 0.0 <= row.cri <= 1.0
        assert (row.final_decision == "VETO") == bool(row.sad_flag)


def test_missing_report_and_no_reports(spark, tables):
    preds, statuses, results, reports = tables
    r = _rows(governed_eval(preds, statuses, results, reports, model_id="m", allow_diff_fallback=False))
    assert r["i"].security_scan_scope == "missing_report" and r["i"].security_scan_failed
    assert r["i"].security_scan_error == "post-apply security report missing"
    n = _rows(governed_eval(preds, statuses, results, None, model_id="m"))
    assert n["i"].security_scan_scope == "diff_fragment_fallback_v2" and n["i"].final_decision == "VETO"
    assert n["a"].security_scan_failed is False  # the added Python parses


def test_survey_ledger_cases(spark):
    """SURVEY 8.1/8.2: cases where the shipped code (followed here) differs
    from what a test might expect."""
    no_space_hunk = ("diff --git a/src/m.py b/src/m.py\n--- a/src/m.py\n+++ b/src/m.py\n@@\n"
                     "+password = \"hunter22\"\n")
    preds = spark.createDataFrame([("x", no_space_hunk), ("y", DIFF_PY), ("z", DIFF_PY)],
                                  "instance_id string, model_patch string")
    statuses = spark.createDataFrame([("y", "success"), ("z", "Timeout")], "instance_id string, status string")
    results = spark.createDataFrame([("y", False, None)], "instance_id string, resolved boolean, resolved_status string")
    r = _rows(governed_eval(preds, statuses, results, None, model_id="m"))
    # '@@' without a trailing space never opens a hunk: nothing scanned -> failed coverage, no veto
    assert r["x"].security_scan_failed and not r["x"].sad_flag and r["x"].final_decision == "ABSTAIN"
    # resolved=false without a status: resolved fields change, earlier CRI and decision stay
    assert r["y"].resolved is False and r["y"].eval_status is None
    assert r["y"].cri == 1.0 and r["y"].final_decision == "OK" and r["y"].total_tests == 1
    # a VETO base status still ends as ABSTAIN
    assert r["z"].final_decision == "ABSTAIN" and r["z"].tests_failed == 1


def test_conformal_thresholds_are_exact_order_statistics(spark):
    import math
    import random
    from decimal import Decimal

    from gavel.operators.aggregates import conformal_thresholds
    rng = random.Random(3)
    for values in ([rng.choice([0.0, 0.2, 0.2000000001, 1e-300, 0.9, 1.0]) for _ in range(400)],
                   [2.0 ** -rng.randint(0, 200) for _ in range(300)], [0.5] * 40, [0.3]):
        rows = [(v, rng.choice([True, False, False, None])) for v in values] + [(None, False), (0.7, False)]
        alphas = ["0.001", "0.05", "0.3", "0.999"]
        got = {r.alpha: r for r in conformal_thresholds(spark.createDataFrame(rows, "cri double, resolved boolean"), alphas, bins=4).collect()}
        known = [(v or 0.0, ok) for v, ok in rows if ok is not None]
        wrong = sorted((v for v, ok in known if not ok), reverse=True)
        for a in alphas:
            rank = int(Decimal(a) * (len(known) + 1))
            tau = math.inf if rank < 1 else -math.inf if rank > len(wrong) else wrong[rank - 1]
            r = got[a]
            assert (r.n, r.n_wrong, r.tau) == (len(known), len(wrong), tau)
            assert r.accepted == sum(v > tau for v, _ in known) and r.wrong_accepted == sum(v > tau for v in wrong)
            assert rank < 1 or (r.wrong_accepted + 1) / (r.n + 1) <= float(a) + 1e-12 or tau == -math.inf


def test_scan_holds_the_facts_of_few_files_only(monkeypatch):
    import pyarrow as pa
    from gavel.operators import astscan as A

    monkeypatch.setattr(A, "HELD", 2)
    sizes, make = [], pa.array
    monkeypatch.setattr(A.pa, "array", lambda x, *a: sizes.append(len(x)) or make(x, *a))
    codes = make([["import random", "def broken(:"], [], ["api_key = 12345"], ["x = 1"], None])
    (got,) = list(A._versions_facts.func(iter([codes])))
    assert max(sizes) == 2 and len(got) == 5
    rows = got.to_pylist()
    assert [[f["kind"] for v in r for f in v["facts"]] for r in rows] == [["import", "unparsable"], [], ["literal"], ["literal"], []]
