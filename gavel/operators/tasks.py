"""Task-suite operators re-aimed as table jobs (BIZ-1..11)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel import constants as K
from gavel.functions.crypto import b64url_nopad, hmac_sha256_hex
from gavel.functions.text import py_strip
from gavel.session import written


# ------------------------------------------------------------------ BIZ-1
MOST_ENTRIES = 4096  # possible entry states of a run; beyond it runs are merged instead


def greedy_rate_limit(events: DataFrame, user: str = "user_id", ts: str = "ts_unit", order: str = "event_id",
                      window: int = K.LIMITER_WINDOW, limit: int = K.LIMITER_LIMIT, span: int | None = None) -> DataFrame:
    """Allow an event when fewer than ``limit`` ALLOWED events of the same
    user lie in [ts - window + 1, ts]; denied events do not count, so a
    plain windowed count is wrong. Events without a time are denied.

    An associative scan, so one user who never pauses spreads over tasks:
    1. Every user's timeline is cut into runs of ``span`` units (at least a
       window). What a run has to know of the past is its entry state: at most
       ``limit`` allowed times in the window - 1 units before it. The events of
       these units come along as a halo, so the states that can occur are known.
    2. One pass in time order (secondary sort) folds each run for all its
       possible entries at once. Entries that lead to the same state are folded
       on together, so after a few events there is mostly one. A run gives its
       exit state per entry, an event either a decision or the entries under
       which it is allowed.
    3. Functions from entry to exit compose: each round a run's function takes
       in the 2^k runs before it, until it is constant, at the latest at a run
       with an empty halo. Only runs whose exit depends on their entry take
       part, so there are log2(longest dependent chain) rounds, usually none.
    4. Only events that depend on the entry are joined with it.
    No run ever merges, no task holds a user's history, no window spans a user.
    """
    if math.comb(window - 1 + limit, limit) > MOST_ENTRIES:
        return _limit_by_merging(events, user, ts, order, window, limit, span)
    span = max(window, span or window * 64)
    run = F.floor(F.col(ts) / span).cast("bigint")
    here, after = F.struct(run.alias("run"), F.lit(False).alias("halo")), F.struct((run + 1).alias("run"), F.lit(True).alias("halo"))
    near_end = F.pmod(F.col(ts), F.lit(span)) > span - window
    dealt = events.select(F.struct(*events.columns).alias("row"), F.col(user).alias("who"), F.col(ts).cast("bigint").alias("t"),
                          F.col(order).alias("pos"),
                          F.explode(F.when(near_end, F.array(here, after)).otherwise(F.array(here))).alias("at"))
    dealt = dealt.select("row", "who", "t", "pos", "at.*")
    schema = T.StructType([*(T.StructField(c, dealt.schema[c].dataType) for c in ("row", "who", "run")),
                           T.StructField("allowed", T.BooleanType()), T.StructField("by", T.ArrayType(T.IntegerType())),
                           T.StructField("exits", T.MapType(T.IntegerType(), T.IntegerType()))])

    def code(state, edge):  # times before the edge as digits, nearest first
        return sum((edge - x) * window ** i for i, x in enumerate(sorted(state, reverse=True)))

    def entries(halo, edge):
        seen = {()}
        for x in halo:
            seen |= {tuple(sorted((*s, x))) for s in seen if len(s) < limit}
        return {s: [code(s, edge)] for s in seen}

    def fold(batches):
        current = states = halo = None
        for batch in batches:
            who, t, runs, is_halo = (batch.column(c).to_pylist() for c in ("who", "t", "run", "halo"))
            rows, allowed, by, ends = [], [], [], []

            def close():  # a finished run: its exits, unless all are empty
                if states is None:
                    return
                edge = (current[1] + 1) * span
                exits = [(e, code([x for x in s if x > edge - window], edge)) for s, es in states.items() for e in es]
                if any(x for _, x in exits):
                    ends.append((*current, exits))

            for i, key in enumerate(zip(who, runs)):
                if key != current:
                    close()
                    current, states, halo = key, None, []
                x = t[i]
                if is_halo[i]:
                    if halo.count(x) < limit:
                        halo.append(x)
                    continue
                rows.append(i)
                if x is None:
                    allowed.append(False)
                    by.append(None)
                    continue
                states = entries(halo, key[1] * span) if states is None else states
                fresh, yes, n = {}, [], 0
                for s, es in states.items():
                    kept = tuple(y for y in s if y > x - window)
                    n += len(es)
                    if len(kept) < limit:
                        kept, yes = (*kept, x), yes + es
                    fresh[kept] = fresh.get(kept, []) + es
                states = fresh
                same = len(yes) in (0, n)
                allowed.append(bool(yes) if same else None)
                by.append(None if same else yes)
            yield _limiter_batch(batch, rows, allowed, by, ends)
        if current is not None:
            ends = []
            close()
            if ends:
                yield _limiter_batch(batch, [], [], [], ends)

    nparts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clustered = dealt.repartition(nparts, "who", "run").sortWithinPartitions("who", "run", "t", "pos")
    out = written(clustered.drop("pos").mapInArrow(fold, schema), "limiter")

    varies = F.size(F.array_distinct(F.map_values("f"))) > 1
    functions, step = out.where("exits is not null").select("who", "run", F.col("exits").alias("f")), 1
    while not functions.where(varies).isEmpty():
        before = functions.select(F.col("who").alias("w"), (F.col("run") + step).alias("r"), F.col("f").alias("g"))
        first = F.when(F.col("g").isNull(), F.create_map(F.lit(0), F.lit(0))).otherwise(F.col("g"))
        grown = functions.where(varies).join(before, F.col("who").eqNullSafe(F.col("w")) & (F.col("run") == F.col("r")), "left").select(
            "who", "run", F.transform_values(first, lambda k, v: F.element_at("f", v)).alias("f"))
        functions = written(functions.where(~varies).unionByName(grown), "limiter-functions")
        step *= 2
    known = functions.select(F.col("who").alias("w"), (F.col("run") + 1).alias("r"), F.map_values("f")[0].alias("entry"))
    open_rows = out.where("by is not null").join(
        known, F.col("who").eqNullSafe(F.col("w")) & (F.col("run") == F.col("r")), "left")
    settled = open_rows.select("row", F.array_contains("by", F.coalesce("entry", F.lit(0))).alias("allowed"))
    return out.where("allowed is not null").select("row", "allowed").unionByName(settled).select("row.*", "allowed")


def _limiter_batch(batch: pa.RecordBatch, rows: list, allowed: list, by: list, ends: list) -> pa.RecordBatch:
    """The event rows ``rows`` of ``batch`` with their decisions, then one row
    for each finished run (users and runs of rows are not read again, but for
    rows that wait for an entry)."""
    picked = pa.array(rows + [None] * len(ends), pa.int64())
    who = batch.column("who").take(pa.array(rows, pa.int64())).to_pylist() + [e[0] for e in ends]
    run = batch.column("run").take(pa.array(rows, pa.int64())).to_pylist() + [e[1] for e in ends]
    nothing = [None] * len(ends)
    return pa.RecordBatch.from_arrays(
        [batch.column("row").take(picked), pa.array(who, batch.column("who").type), pa.array(run, pa.int64()),
         pa.array(allowed + nothing, pa.bool_()), pa.array(by + nothing, pa.list_(pa.int32())),
         pa.array([None] * len(rows) + [e[2] for e in ends], pa.map_(pa.int32(), pa.int32()))],
        names=["row", "who", "run", "allowed", "by", "exits"])


def _limit_by_merging(events: DataFrame, user: str, ts: str, order: str, window: int, limit: int, span: int | None) -> DataFrame:
    """The limiter for limits whose entry states are too many to fold at once.

    Runs are folded from an empty state; where the predecessor's exit differs
    from the state assumed, a run is merged with its neighbour (runs double in
    length) and folded again from the best known entry, at most log2(runs)
    times. Rows stream through the fold; no task holds a user's history.
    """
    from gavel.session import ensure_checkpoint_dir
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = max(window, span or window * 64)
    key = [user, "_run"]
    data = events.withColumn("_run", F.floor(F.col(ts) / span).cast("bigint"))
    states = T.ArrayType(T.LongType())
    out_schema = T.StructType([*data.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("_after", states)])

    def fold(batches):
        current, kept = None, []
        for pdf in batches:
            allowed, after = [], []
            for who, run, t, entry in zip(pdf[user], pdf["_run"], pdf[ts], pdf["_entry"]):
                if (who, run) != current:
                    current, kept = (who, run), [] if entry is None else [int(x) for x in entry]
                kept = [x for x in kept if x > t - window]
                allowed.append(len(kept) < limit)
                if allowed[-1]:
                    kept.append(int(t))
                after.append(kept)
            yield pdf.drop(columns=["_entry"]).assign(allowed=allowed, _after=after)

    def folded(rows: DataFrame) -> DataFrame:
        clustered = rows.repartition(nparts, *key).sortWithinPartitions(*key, ts, order)
        return clustered.mapInPandas(fold, out_schema)

    empty = F.array().cast(states)
    out = folded(data.withColumn("_entry", empty)).checkpoint()
    used = None  # entry states other than the empty one
    while True:
        ends = out.groupBy(*key).agg(F.max_by("_after", F.struct(ts, order)).alias("_exit"), F.min(ts).alias("_first"))
        before = ends.select(user, (F.col("_run") + 1).alias("_run"), "_exit")
        need = ends.select(*key, "_first").join(before, key, "left").select(
            *key, F.filter(F.coalesce("_exit", empty), lambda t: t > F.col("_first") - window).alias("_entry"))
        need = (need.withColumn("_used", empty) if used is None
                else need.join(used, key, "left").withColumn("_used", F.coalesce("_used", empty)))
        need = need.withColumn("_wrong", F.col("_entry") != F.col("_used")).checkpoint()
        if need.where("_wrong").isEmpty():
            return out.drop("_run", "_after")
        merged = F.floor(F.col("_run") / 2).cast("bigint")
        runs = need.groupBy(user, merged.alias("_run")).agg(
            F.min_by("_entry", "_run").alias("_entry"), F.max("_wrong").alias("_wrong"))
        out = out.withColumn("_run", merged).join(runs, key)
        redo = folded(out.where("_wrong").drop("allowed", "_after", "_wrong"))
        out = out.where("not _wrong").drop("_wrong", "_entry").unionByName(redo).checkpoint()
        used = runs.select(*key, F.col("_entry").alias("_used"))


# ------------------------------------------------------------------ BIZ-2
def monthly_bills(usage: DataFrame) -> DataFrame:
    """Tiered billing per (account, month): base + max(0, calls - included)
    * rate in DECIMAL, rounded half-up to cents; negative calls or an
    unknown plan give an error row instead of a bill."""
    spark = usage.sparkSession
    plans = spark.createDataFrame([(p, inc, rate, base) for p, inc, rate, base in K.BILLING_PLANS],
                                  "plan string, included bigint, rate string, base string")
    plans = plans.select("plan", "included", F.col("rate").cast("decimal(18,6)").alias("rate"),
                         F.col("base").cast("decimal(18,6)").alias("base"))
    u = usage.withColumn("_plan", F.lower(F.col("plan")))
    # The plan table has a fixed size (three rows): broadcasting it is bounded.
    j = u.join(F.broadcast(plans.withColumnRenamed("plan", "_plan")), "_plan", "left")
    extra = F.greatest(F.col("calls") - F.col("included"), F.lit(0)).cast("decimal(20,0)")
    bill = F.round(F.col("base") + extra * F.col("rate"), 2).cast("decimal(18,2)")
    err = (F.when(F.col("calls") < 0, F.lit("calls must be non-negative"))
           .when(F.col("included").isNull(), F.lit("unknown plan")))
    return j.select("account", "month", "plan", "calls", F.when(err.isNull(), bill).alias("amount"),
                    err.alias("error"))


# ------------------------------------------------------------------ BIZ-3
def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Extension/content-type pair from the allowed map, size 1..5 MiB."""
    fn, ct, size = F.col("filename"), F.col("content_type"), F.col("size_bytes")
    ext = F.lower(F.substring_index(fn, ".", -1))
    expected = F.lit(None).cast("string")
    for e, t in reversed(K.UPLOAD_TYPES):
        expected = F.when(ext == e, F.lit(t)).otherwise(expected)
    ok = (fn.isNotNull() & ct.isNotNull() & (fn != "") & fn.contains(".") & size.isNotNull()
          & (size > 0) & (size <= K.UPLOAD_MAX_BYTES) & expected.isNotNull() & (F.lower(ct) == F.lower(expected)))
    return uploads.withColumn("valid", F.coalesce(ok, F.lit(False)))


# ------------------------------------------------------------------ BIZ-4
def prefix_search(users: DataFrame, prefix: str, name_col: str = "username") -> DataFrame:
    """Users whose name is LIKE prefix || '%' (the prefix is a bound value;
    as in the parameterised query, '%' and '_' inside it are wildcards)."""
    return users.where(F.col(name_col).like(prefix + "%"))


# ------------------------------------------------------------------ BIZ-5
def check_credentials(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """unknown user or wrong hash -> invalid_credentials; inactive ->
    inactive_user; else ok. One left join on username."""
    u = users.select(F.col("username").alias("_u"), "password_hash", "is_active")
    j = attempts.join(u, attempts["username"] == u["_u"], "left")
    provided = F.sha2(F.col("password"), 256)
    res = (F.when(F.col("_u").isNull() | F.col("password_hash").isNull(), F.lit("invalid_credentials"))
           .when(F.col("password_hash") != provided, F.lit("invalid_credentials"))
           .when(~F.coalesce(F.col("is_active"), F.lit(False)), F.lit("inactive_user"))
           .otherwise(F.lit("ok")))
    return j.select(*[attempts[c] for c in attempts.columns if c != "password"], res.alias("result"),
                    (res == "ok").alias("ok"))


# ------------------------------------------------------------------ BIZ-6
def reset_tokens(df: DataFrame, secret_key: str, user: str = "user_id", issued: str = "issued_at") -> DataFrame:
    """URL-safe base64 of HMAC-SHA256(key, 'user:issued_at'), no padding."""
    msg = F.concat(F.col(user).cast("string"), F.lit(":"), F.col(issued).cast("string"))
    return df.withColumn("token", b64url_nopad(hmac_sha256_hex(secret_key, msg)))


# ------------------------------------------------------------------ BIZ-7
def verify_bearer(requests: DataFrame, secret_key: str, header: str = "auth_header") -> DataFrame:
    """Five failure reasons in order, else ok with the user id."""
    h = F.col(header)
    parts = F.split(h, " ", 2)
    token = py_strip(F.try_element_at(parts, F.lit(2)))
    user = F.regexp_extract(token, r"(?s)^(.*)\.", 1)
    sig = F.substring_index(token, ".", -1)
    expected = hmac_sha256_hex(secret_key, user)
    reason = (F.when(h.isNull() | (h == ""), F.lit("missing_authorization"))
              .when((F.size(parts) != 2) | (F.element_at(parts, 1) != "Bearer"), F.lit("invalid_authorization_format"))
              .when(token == "", F.lit("empty_token"))
              .when(~token.contains("."), F.lit("invalid_token_format"))
              .when((user == "") | (sig == ""), F.lit("invalid_token_parts"))
              .when(sig != expected, F.lit("invalid_token_signature")))
    return requests.withColumn("error", reason).withColumn("user_id", F.when(reason.isNull(), user))


# ------------------------------------------------------------------ BIZ-8
def audit_fanout(actions: DataFrame, user: str = "user_id", action: str = "action") -> DataFrame:
    """Two rows per action (USER_ACTION, AUDIT_TRAIL) with the same message;
    both come from one generator over one input row, so they are written in
    the same task and commit together."""
    msg = F.concat(F.lit("user="), F.col(user).cast("string"), F.lit(" action="), F.col(action).cast("string"))
    ev = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("USER_ACTION").alias("type"), msg.alias("message")),
                           F.struct(F.lit(1).alias("n"), F.lit("AUDIT_TRAIL").alias("type"), msg.alias("message"))))
    keep = [c for c in actions.columns]
    return actions.select(*keep, ev.alias("e")).select(*keep, "e.n", "e.type", "e.message")


# ------------------------------------------------------------------ BIZ-9
SESSION_OUT = T.StructType([
    T.StructField("chain_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("owner", T.StringType()), T.StructField("live_after", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


def session_ops(log: DataFrame) -> DataFrame:
    """Replay a create/invalidate/rotate log per chain (a chain is a created
    id and its rotations; an id is issued once, so chains never interact).

    Output: one row per op with the resulting owner, whether the id named
    by the row (the new id for create/rotate) is live afterwards, and an
    error for rotations of ids that are not live.

    An op acts on a live id when it is the first to use the id after its
    issue and the issue itself took effect. The first part is local to an
    id; the second is followed from rotation to rotation by pointer doubling,
    so a chain of n rotations takes log2(n) joins and no chain is ever
    gathered in a task.
    """
    from gavel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(log.sparkSession)
    ops = log.select(F.col("chain_id").cast("bigint"), F.col("seq").cast("bigint"), "op", "session_id", "user_id",
                     "new_session_id")
    key = ["chain_id", "session_id"]
    issues = ops.where("op <> 'invalidate'").select(
        "chain_id", F.when(F.col("op") == "create", F.col("session_id")).otherwise(F.col("new_session_id")).alias("session_id"),
        F.col("seq").alias("issued"), (F.col("op") == "create").alias("root"), F.col("user_id").alias("root_user"))
    uses = ops.where("op <> 'create'").join(issues, key, "left").withColumn("later", F.col("issued") < F.col("seq"))
    first = uses.where("later").groupBy(*key).agg(F.min("seq").alias("first_use"))
    uses = uses.join(first, key, "left").withColumn("takes", F.coalesce(
        F.col("later") & (F.col("seq") == F.col("first_use")), F.lit(False)))
    # up: the row that must have taken effect for this one; null at a create or where nothing is taken
    step = uses.select("chain_id", "seq", "takes", F.when(F.col("takes") & ~F.col("root"), F.col("issued")).alias("up"),
                       F.when(F.col("takes") & F.col("root"), F.col("root_user")).alias("owner")).checkpoint()
    while not step.where("up is not null").isEmpty():
        above = step.select("chain_id", F.col("seq").alias("up"), F.col("takes").alias("_t"), F.col("up").alias("_u"),
                            F.col("owner").alias("_o"))
        step = step.join(above, ["chain_id", "up"], "left").select(
            "chain_id", "seq", (F.col("takes") & F.coalesce("_t", F.lit(True))).alias("takes"),
            F.when(F.col("takes") & F.coalesce("_t", F.lit(True)), F.col("_u")).alias("up"),
            F.when(F.col("up").isNull(), F.col("owner")).otherwise(F.col("_o")).alias("owner")).checkpoint()
    done = ops.join(step.select("chain_id", "seq", "takes", F.col("owner").alias("_owner")), ["chain_id", "seq"], "left")
    create, rotate = F.col("op") == "create", F.col("op") == "rotate"
    takes = F.coalesce("takes", F.lit(False))
    return done.select(
        "chain_id", "seq", "op", F.when(rotate, F.col("new_session_id")).otherwise(F.col("session_id")).alias("session_id"),
        F.when(create, F.col("user_id")).when(takes, F.col("_owner")).alias("owner"),
        (create | (rotate & takes)).alias("live_after"),
        F.when(rotate & ~takes, F.lit("unknown session id")).alias("error"))


def live_sessions(log: DataFrame) -> DataFrame:
    """Ids live at the end of the log with their owner: ids issued by a create
    or an effective rotate that no later op names."""
    issued = session_ops(log).where("live_after").select("chain_id", "session_id", "seq", "owner")
    last_use = (log.where(F.col("op").isin("invalidate", "rotate")).groupBy(F.col("chain_id").cast("bigint").alias("chain_id"), "session_id")
                .agg(F.max(F.col("seq").cast("bigint")).alias("last_use")))
    return (issued.join(last_use, ["chain_id", "session_id"], "left")
            .where(F.col("last_use").isNull() | (F.col("last_use") < F.col("seq")))
            .select("session_id", "chain_id", F.col("owner").alias("user_id")))


# ------------------------------------------------------------------ BIZ-10
def ledger_audit(transfers: DataFrame, accounts: DataFrame, chunk_span: int = 1 << 16):
    """Reject non-positive amounts, unknown accounts and actors who do not
    own the source; each accepted transfer yields a debit and a credit
    posting together; a posting that takes the running balance (opening
    balance + postings in transfer order) below zero is flagged."""
    a_src = accounts.select(F.col("account_id").alias("source"), F.col("owner_id").alias("_owner"))
    a_tgt = accounts.select(F.col("account_id").alias("target"), F.lit(True).alias("_tgt_known"))
    j = transfers.join(a_src, "source", "left").join(a_tgt, "target", "left")
    reason = (F.when(F.col("amount").isNull() | (F.col("amount") <= 0), F.lit("non_positive_amount"))
              .when(F.col("_owner").isNull() | F.col("_tgt_known").isNull(), F.lit("unknown_account"))
              .when(F.col("_owner") != F.col("actor"), F.lit("not_owner")))
    checked = j.withColumn("rejection", reason).drop("_owner", "_tgt_known")
    post = F.explode(F.array(F.struct(F.col("source").alias("account_id"), (-F.col("amount")).alias("delta"),
                                      F.lit("debit").alias("kind"), F.lit(0).alias("n")),
                             F.struct(F.col("target").alias("account_id"), F.col("amount").alias("delta"),
                                      F.lit("credit").alias("kind"), F.lit(1).alias("n"))))
    postings = checked.where(F.col("rejection").isNull()).select("seq", post.alias("p")).select("seq", "p.*")
    opening = accounts.select("account_id", F.col("balance").alias("opening"))
    # Two-level prefix sum, exact and parallel for hot accounts: running sums
    # inside (account, seq-range chunk) windows, plus the prefix over the
    # small table of chunk totals per account.
    p = postings.withColumn("_chunk", F.floor(F.col("seq") / chunk_span).cast("bigint"))
    w_in = Window.partitionBy("account_id", "_chunk").orderBy("seq", "n").rowsBetween(Window.unboundedPreceding, 0)
    totals = p.groupBy("account_id", "_chunk").agg(F.sum("delta").alias("_t"))
    w_ch = Window.partitionBy("account_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(w_ch), F.lit(0))).drop("_t")
    ledger = (p.withColumn("_run", F.sum("delta").over(w_in))
              .join(before, ["account_id", "_chunk"], "left")
              .join(opening, "account_id", "left")
              .withColumn("balance_after", F.col("opening") + F.col("_before") + F.col("_run"))
              .withColumn("overdrawn", F.col("balance_after") < 0)
              .drop("_chunk", "_run", "_before"))
    return checked, ledger


# ------------------------------------------------------------------ BIZ-11
def html_escape(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def render_profiles(profiles: DataFrame) -> DataFrame:
    html = F.concat(F.lit('<div class="profile"><h1>'), html_escape("username"), F.lit("</h1><p>"),
                    html_escape("bio"), F.lit("</p></div>"))
    return profiles.withColumn("html", html)
