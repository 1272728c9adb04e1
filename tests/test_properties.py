"""Property checks (hypothesis) over small random tables."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gavel.operators import aggregates as A
from gavel.operators.governance import governed_eval
from gavel.sources.files import merge_statuses

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

violation = st.sampled_from(["[info] A", "[high] B", "C", "  [info] D", "[other] E"])
eval_row = st.tuples(st.sampled_from(["OK", "ABSTAIN", "VETO", None]), st.one_of(st.none(), st.booleans()),
                     st.one_of(st.none(), st.floats(0, 1)), st.booleans(), st.booleans())


@SETTINGS
@given(st.lists(eval_row, min_size=1, max_size=40))
def test_sweep_properties(spark, rows):
    df = spark.createDataFrame([(d, r, c, s, f) for d, r, c, s, f in rows],
                               "final_decision string, resolved boolean, cri double, sad_flag boolean, "
                               "security_scan_failed boolean")
    sweep = sorted(A.risk_coverage(df, (0.0, 0.3, 0.6, 0.9)).collect(), key=lambda r: r.threshold)
    acc = [r.accepted for r in sweep]
    assert acc == sorted(acc, reverse=True)          # monotone in the threshold
    for r in sweep:
        assert r.total == len(rows) and 0.0 <= r.risk <= 1.0 and 0.0 <= r.coverage <= 1.0
        assert r.false_accepts + r.resolved_ok <= r.accepted
    gate = A.ci_gate(df).first()
    assert gate.ok + gate.abstain + gate.veto == gate.total
    assert gate.passed == (gate.veto == 0)


@SETTINGS
@given(st.lists(st.tuples(st.lists(violation, max_size=3), st.booleans(), st.sampled_from(["success", "error", "",
                                                                                            "pending"]),
                          st.one_of(st.none(), st.booleans())), min_size=1, max_size=12))
def test_governance_invariants(spark, items):
    preds = spark.createDataFrame([(f"i{n}", "diff --git a/a b/a\n") for n in range(len(items))],
                                  "instance_id string, model_patch string")
    reports = spark.createDataFrame([(f"i{n}", None, failed, None, None, v, False) for n, (v, failed, _, _) in
                                     enumerate(items)],
                                    "instance_id string, scan_scope string, scan_failed boolean, scan_ok boolean, "
                                    "scan_error string, new_violations array<string>, corrupt boolean")
    statuses = spark.createDataFrame([(f"i{n}", s) for n, (_, _, s, _) in enumerate(items)],
                                     "instance_id string, status string")
    results = spark.createDataFrame([(f"i{n}", r, None) for n, (_, _, _, r) in enumerate(items) if r is not None],
                                    "instance_id string, resolved boolean, resolved_status string")
    out = governed_eval(preds, statuses, results, reports, model_id="m").collect()
    assert len(out) == len(items)
    for row in out:
        assert 0.0 <= row.cri <= 1.0
        high = any(not v.lstrip().startswith("[info]") for v in row.security_violations)
        assert row.sad_flag == high
        assert (row.final_decision == "VETO") == high
        assert row.final_decision in ("OK", "ABSTAIN", "VETO")


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(["s1", "s2", None]),
                          st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=30))
def test_last_write_wins_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "instance_id string, status string, file long, pos long")
    once = merge_statuses(df)
    twice = merge_statuses(once.withColumn("file", once["status"].isNull().cast("long")).withColumn("pos",
                                                                                                   once["status"].isNull().cast("long")))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    expect = {}
    for i, s, f, p in sorted(rows, key=lambda r: (r[2], r[3])):
        if s is not None:
            expect[i] = s
    got = {r.instance_id: r.status for r in once.collect()}
    ties = {(i, f, p) for i, s, f, p in rows}
    if len(ties) == len(rows):  # unique order keys: the last write is well defined
        assert got == expect
