"""Task-suite operators against plain-Python brute force on small inputs."""

import base64
import hashlib
import hmac
import random

from pyspark.sql import functions as F

from gavel.operators import ordered as O
from gavel.operators import tasks as B


def brute_limiter(events, window=10, limit=3):
    kept, out = {}, {}
    for eid, user, ts in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        dq = kept.setdefault(user, [])
        while dq and dq[0] < ts - window + 1:
            dq.pop(0)
        if len(dq) >= limit:
            out[eid] = False
        else:
            dq.append(ts)
            out[eid] = True
    return out


def test_limiter_matches_brute_force(spark):
    rnd = random.Random(7)
    events = []
    for eid in range(3000):
        user = rnd.choice([0, 1, 2, 3, 0, 0])  # user 0 is hot
        events.append((eid, user, rnd.randint(0, 400)))
    df = spark.createDataFrame(events, "event_id long, user_id long, ts_unit long")
    got = {r.event_id: r.allowed for r in B.greedy_rate_limit(df).collect()}
    assert got == brute_limiter(events)


def test_hmac_and_tokens(spark):
    df = spark.createDataFrame([("u1", 1700000000), ("ü", 5)], "user_id string, issued_at long")
    rows = B.reset_tokens(df, "k3y").collect()
    for r in rows:
        d = hmac.new(b"k3y", f"{r.user_id}:{r.issued_at}".encode(), hashlib.sha256).digest()
        assert r.token == base64.urlsafe_b64encode(d).rstrip(b"=").decode()


def test_bearer_reasons(spark):
    sig = hmac.new(b"key", b"alice", hashlib.sha256).hexdigest()
    hdrs = [None, "Token x", "Bearer ", "Bearer nodot", "Bearer .sig", "Bearer alice.bad", f"Bearer alice.{sig}"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hdrs)], "request_id int, auth_header string")
    out = {r.request_id: (r.error, r.user_id) for r in B.verify_bearer(df, "key").collect()}
    assert [out[i][0] for i in range(6)] == ["missing_authorization", "invalid_authorization_format", "empty_token",
                                             "invalid_token_format", "invalid_token_parts", "invalid_token_signature"]
    assert out[6] == (None, "alice")


def test_billing_uploads_escape(spark):
    usage = spark.createDataFrame([("a", "2024-01", 1500, "free"), ("b", "2024-01", 10, "PRO"),
                                   ("c", "2024-01", -1, "free"), ("d", "2024-01", 5, "gold")],
                                  "account string, month string, calls long, plan string")
    bills = {r.account: (r.amount, r.error) for r in B.monthly_bills(usage).collect()}
    assert float(bills["a"][0]) == 5.0 and float(bills["b"][0]) == 49.0
    assert bills["c"][1] == "calls must be non-negative" and bills["d"][1] == "unknown plan"
    up = spark.createDataFrame([("a.PNG", "image/png", 10), ("a.jpg", "image/png", 10), ("noext", "image/png", 1),
                                ("b.pdf", "application/pdf", 6 * 1024 * 1024)],
                               "filename string, content_type string, size_bytes long")
    assert [r.valid for r in B.validate_uploads(up).collect()] == [True, False, False, False]
    p = spark.createDataFrame([("<b>&'\"", "x>y")], "username string, bio string")
    html = B.render_profiles(p).first().html
    assert html == '<div class="profile"><h1>&lt;b&gt;&amp;&#x27;&quot;</h1><p>x&gt;y</p></div>'


def test_sessions_and_audit(spark):
    log = spark.createDataFrame([
        (1, 1, "create", "s1", "u1", None), (1, 2, "rotate", "s1", None, "s2"), (1, 3, "rotate", "s1", None, "s3"),
        (1, 4, "invalidate", "s2", None, None), (2, 1, "create", "t1", "u2", None), (2, 2, "rotate", "t1", None, "t2"),
    ], "chain_id long, seq long, op string, session_id string, user_id string, new_session_id string")
    live = {r.session_id: r.user_id for r in B.live_sessions(log).collect()}
    assert live == {"t2": "u2"}
    errors = [r for r in B.session_ops(log).collect() if r.error]
    assert len(errors) == 1 and errors[0].seq == 3
    acts = spark.createDataFrame([("u1", "login")], "user_id string, action string")
    out = B.audit_fanout(acts).orderBy("n").collect()
    assert [(r.type, r.message) for r in out] == [("USER_ACTION", "user=u1 action=login"),
                                                   ("AUDIT_TRAIL", "user=u1 action=login")]


def test_best_of_k_ranking(spark):
    cands = spark.createDataFrame([
        ("i1", 0, "veto", True, 0.99, ["X"], False, 1, 10), ("i1", 1, "ok", True, 0.5, [], False, 1, 10),
        ("i2", 0, "abstain", False, 0.9, [], False, 1, 10), ("i2", 1, "ok", True, 0.1, [], False, 1, 10),
        ("i3", 0, "low", True, 0.5, [], False, 1, 10), ("i3", 1, "high", True, 0.7, [], False, 1, 10),
        ("i4", 0, "first", True, 0.5, [], False, 1, 10), ("i4", 1, "second", True, 0.5, [], False, 1, 10),
    ], "instance_id string, cand_idx long, candidate_dir string, resolved boolean, cri double, "
       "security_violations array<string>, security_scan_failed boolean, changed_files long, patch_size long")
    best = {r.instance_id: r.candidate_dir for r in O.best_of_k(cands).collect()}
    assert best == {"i1": "ok", "i2": "ok", "i3": "high", "i4": "first"}


def test_iteration_fold(spark):
    iters = spark.createDataFrame([
        ("r1", 1, 4, 2, 0, 0), ("r1", 2, 4, 2, 0, 0), ("r1", 3, 4, 0, 0, 0),   # plateau at step 2
        ("r2", 1, 4, 0, 0, 0), ("r2", 2, 4, 0, 0, 0),                          # OK at step 1
        ("r3", 1, 4, 4, 0, 0), ("r3", 2, 4, 2, 0, 0), ("r3", 3, 4, 1, 0, 0), ("r3", 4, 4, 0, 0, 0),
    ], "run string, tau_step long, total_tests long, tests_failed long, n_violations long, n_lint long")
    f = {r.run: r for r in O.iteration_fold(iters).collect()}
    assert f["r1"].iterations == 2 and f["r1"].final_decision == "ABSTAIN"
    assert f["r2"].iterations == 1 and f["r2"].final_decision == "OK"
    assert f["r3"].iterations == 3 and f["r3"].last_tau == 3
    assert f["r3"].cri_history == [0.0, 0.5, 0.75]
    assert f["r3"].cri_improvement == 0.75


def test_limiter_dense_hot_user_chunks(spark):
    rnd = random.Random(11)
    events = [(eid, 0 if eid % 3 else rnd.choice([1, 2]), eid // 2 + rnd.randint(0, 1)) for eid in range(2000)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts_unit long")
    # a tiny span forces many chunks per dense segment and several fix-point rounds
    got = {r.event_id: r.allowed for r in B.greedy_rate_limit(df, span=37).collect()}
    assert got == brute_limiter(events)


def test_ledger_chunked_prefix_equals_single_window(spark):
    from decimal import Decimal
    rnd = random.Random(3)
    accounts = spark.createDataFrame([(f"a{i}", f"u{i}", Decimal("50.00")) for i in range(4)],
                                     "account_id string, owner_id string, balance decimal(18,2)")
    rows = []
    for seq in range(400):
        src = rnd.choice(["a0", "a0", "a0", "a1", "a2", "a3"])  # a0 is hot
        rows.append((seq, "u" + src[1:], src, rnd.choice(["a0", "a1", "a2", "a3", "zz"]),
                     Decimal(rnd.randint(-2, 30))))
    transfers = spark.createDataFrame(rows, "seq long, actor string, source string, target string, amount decimal(18,2)")
    _, small = B.ledger_audit(transfers, accounts, chunk_span=7)
    _, big = B.ledger_audit(transfers, accounts, chunk_span=1 << 30)
    key = lambda r: (r.seq, r.kind)
    a = sorted(((r.seq, r.kind, r.account_id, r.balance_after, r.overdrawn) for r in small.collect()))
    b = sorted(((r.seq, r.kind, r.account_id, r.balance_after, r.overdrawn) for r in big.collect()))
    assert a == b and any(x[4] for x in a)


def test_limiter_never_pausing_user_over_many_runs(spark):
    """The state shifts from run to run: every merge level takes part."""
    events = [(i, 5, i) for i in range(900)] + [(900 + i, 6, 3 * i) for i in range(300)] + [(1200 + i, 7, 40 * i) for i in range(50)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts_unit long")
    got = {r.event_id: r.allowed for r in B.greedy_rate_limit(df, span=7).collect()}
    assert got == brute_limiter(events)


def test_limiter_dependent_chain_spreads_and_clashing_columns(spark):
    """One user who never pauses, dense enough that every run's exit depends on
    its entry; tiny Arrow batches; columns named like the operator's own."""
    rnd = random.Random(2)
    t, events = 0, []
    for eid in range(1500):
        events.append((eid, None if eid % 2 else 9, t, "r", "w", True, eid, 1))
        t += rnd.choice([0, 1, 3, 3, 4])
    df = spark.createDataFrame(events + [(1500, 9, None, "r", "w", False, 0, 1)],
                               "event_id long, user_id long, ts_unit long, row string, who string, halo boolean, run int, allowed_ int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = B.greedy_rate_limit(df, span=10)
        got = {r.event_id: r.allowed for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert out.columns == [*df.columns, "allowed"]
    assert got == brute_limiter([(e[0], e[1] or 0, e[2]) for e in events]) | {1500: False}
    assert B.greedy_rate_limit(df.limit(0)).count() == 0


def test_limiter_with_many_entry_states_merges_runs(spark):
    rnd = random.Random(5)
    events = [(i, rnd.randint(0, 1), rnd.randint(0, 300)) for i in range(900)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts_unit long")
    wide = {r.event_id: r.allowed for r in B.greedy_rate_limit(df, window=40, limit=20, span=50).collect()}
    queues, want = {}, {}
    for eid, user, ts in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        kept = [x for x in queues.get(user, []) if x > ts - 40]
        want[eid] = len(kept) < 20
        queues[user] = kept + [ts] if want[eid] else kept
    assert wide == want


def test_session_chains_by_pointer_doubling(spark):
    """Long rotation chains, broken links and uses before the issue against a
    plain replay."""
    rnd = random.Random(6)
    rows, expect, live_expect = [], {}, set()
    for chain in range(12):
        live, ids, seq = {}, [f"{chain}-0"], 0
        ops = [("create", ids[0], f"u{chain}", None)]
        if chain == 1:
            ops.insert(0, ("invalidate", ids[0], None, None))  # before the issue: no effect
        for k in range(40 if chain == 0 else 9):
            src = ids[-1] if chain == 0 or rnd.random() < 0.7 else rnd.choice(ids)
            if chain and rnd.random() < 0.2:
                ops.append(("invalidate", src, None, None))
            else:
                ids.append(f"{chain}-{k + 1}")
                ops.append(("rotate", src, None, ids[-1]))
        for op, sid, user, new in ops:
            seq += 1
            rows.append((chain, seq, op, sid, user, new))
            owner = user if op == "create" else live.pop(sid, None)
            named = new if op == "rotate" else sid
            alive = op == "create" or (op == "rotate" and owner is not None)
            if alive:
                live[named] = owner
            expect[(chain, seq)] = (named, owner, alive, "unknown session id" if op == "rotate" and owner is None else None)
        live_expect |= {(s, chain, o) for s, o in live.items()}
    log = spark.createDataFrame(rows, "chain_id long, seq long, op string, session_id string, user_id string, new_session_id string")
    got = {(r.chain_id, r.seq): (r.session_id, r.owner, r.live_after, r.error) for r in B.session_ops(log).collect()}
    assert got == expect
    assert {tuple(r) for r in B.live_sessions(log).collect()} == live_expect
