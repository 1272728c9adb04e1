"""Registered queries: security rules, joins, ablation/diagnostic counts and
canonical JSON / signing (SEC-*, JN-*, AGG-8/10/13, JSN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions import crypto as C
from gavel.functions import security as S
from gavel.functions import text as X
from gavel.functions import textops as TX
from gavel.operators import delta as D
from gavel.operators import joins as J
from gavel.plans import sqltext as Q
from gavel.plans.sqltext import q
from gavel.sources.bridges import DEMO_KEY, bridge, oracle_cte

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, oracle=None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _re2(p: str) -> str:
    return q(Q.re2(p))


# ------------------------------------------------------------------ SEC-1..9
def _rule_sql() -> str:
    t = "code"
    writes = f"len(regexp_extract_all({t}, {_re2(K.RULE_WRITES)}))"
    items = [
        ("SQLI", f"regexp_matches({t}, {_re2(K.RULE_SQLI_TEMPLATE)})", "SQLI_TEMPLATE_INTERPOLATION"),
        ("SQLI", f"regexp_matches({t}, {_re2(K.RULE_SQLI_CONCAT)})", "SQLI_STRING_CONCAT"),
        ("SQLI", f"regexp_matches({t}, {_re2(K.RULE_SQLI_FSTRING)})", "SQLI_FSTRING"),
        ("SQLI", f"regexp_matches({t}, {_re2(K.RULE_SQL_VERB)}) AND NOT regexp_matches({t}, {_re2(K.RULE_SQL_PARAMS)})",
         "SQLI_NO_PARAMETERIZATION"),
        ("MISSING_AUTH", f"regexp_matches({t}, {_re2(K.RULE_ENDPOINT)}) AND regexp_matches({t}, {_re2(K.RULE_MENTIONS_USER)})"
         f" AND NOT regexp_matches({t}, {_re2(K.RULE_HAS_AUTH)})", "MISSING_AUTH_CHECK"),
        ("NO_TRANSACTION", f"{writes} >= 2 AND NOT regexp_matches({t}, {_re2(K.RULE_TX)})", "NO_TRANSACTION_FOR_MULTI_WRITE"),
        ("XSS", f"regexp_matches({t}, {_re2(K.RULE_XSS)})", "POTENTIAL_XSS"),
        ("SECRETS", f"regexp_matches({t}, {_re2(K.RULE_SECRETS)})", "HARDCODED_SECRETS"),
    ]
    cases = ", ".join(f"CASE WHEN list_contains(rules, '{fam}') AND ({cond}) THEN '{name}' END"
                      for fam, cond, name in items)
    return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda z: z IS NOT NULL))), ';')"


@register("sec01_09_rule_findings", oracle_cte("b_code") + f"""
SELECT doc_id, {_rule_sql()} AS findings FROM b_code""")
def sec01(spark, sf):
    b = bridge(spark, sf, "b_code")
    return b.select("doc_id", F.array_join(S.rule_findings("code", F.col("rules")), ";").alias("findings"))


@register("sec11_substring_findings", oracle_cte("b_code") + """
SELECT doc_id, array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(code, {q(n)})' for n in ns)} THEN '{r}' END" for r, ns in K.SUBSTRING_RULES)
    + """, CASE WHEN (""" + " OR ".join(f"contains(lower(code), {q(w)})" for w in K.SUBSTRING_SQL_WORDS)
    + ") AND (" + " OR ".join(f"contains(code, {q(f)})" for f in K.SUBSTRING_FQUOTES) + """) THEN 'SQLI_FSTRING' END],
  lambda z: z IS NOT NULL), ';') AS findings
FROM b_code""")
def sec11(spark, sf):
    b = bridge(spark, sf, "b_code")
    return b.select("doc_id", F.array_join(S.substring_findings("code"), ";").alias("findings"))


# ------------------------------------------------------------------ SEC-9, 10, 12, 14, 16
# The oracle knows each code form's outcome: what a Python parser finds in it.
_FOUND = ("CASE form WHEN 0 THEN 'SQLI_STRING_CONCAT' WHEN 1 THEN 'HARDCODED_SECRETS' WHEN 2 THEN 'MISSING_AUTH_CHECK' "
          "WHEN 3 THEN 'NO_TRANSACTION_FOR_MULTI_WRITE' WHEN 5 THEN 'SYNTAX_ERROR_PREVENTS_SECURITY_SCAN' END")
_FAMILY = "CASE form WHEN 0 THEN 'SQLI' WHEN 1 THEN 'SECRETS' WHEN 2 THEN 'MISSING_AUTH' WHEN 3 THEN 'NO_TRANSACTION' END"
_NO_LEN = "object of type ''int'' has no len()"
_AST = (f"CASE WHEN form = 4 THEN NULL WHEN form = 5 OR list_contains(rules, {_FAMILY}) THEN {_FOUND} ELSE '' END")


def _sub_sql(active) -> str:
    cases = [f"CASE WHEN {' OR '.join(f'contains(code, {q(n)})' for n in ns)} THEN '{r}' END"
             for r, ns in K.SUBSTRING_RULES if r in active]
    if "SQLI_FSTRING" in active:
        cases.append("CASE WHEN (" + " OR ".join(f"contains(lower(code), {q(w)})" for w in K.SUBSTRING_SQL_WORDS) + ") AND ("
                     + " OR ".join(f"contains(code, {q(f)})" for f in K.SUBSTRING_FQUOTES) + ") THEN 'SQLI_FSTRING' END")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda z: z IS NOT NULL), ';')" if cases else "''"


@register("sec10_ast_scan", oracle_cte("b_code") + f"""
SELECT doc_id, {_AST} AS findings, CASE WHEN form = 4 THEN '{_NO_LEN}' END AS scan_error FROM b_code""")
def sec10(spark, sf):
    b = bridge(spark, sf, "b_code")
    s = D.scan_files(b, "code", rules_col="rules")
    return s.select("doc_id", F.array_join("findings", ";").alias("findings"), "scan_error")


@register("sec09_findings_union", oracle_cte("b_code") + f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(
         string_split({_rule_sql()}, ';') || [{_AST}], lambda z: z IS NOT NULL AND z <> ''))), ';') AS findings
FROM b_code""")
def sec09(spark, sf):
    s = D.scan_files(bridge(spark, sf, "b_code"), "code", rules_col="rules")
    return s.select("doc_id", F.array_join(S.merge_findings(S.rule_findings("code", F.col("rules")), F.col("findings")), ";")
                    .alias("findings"))


@register("sec12_scan_with_fallback", oracle_cte("b_code") + f""",
s AS (SELECT doc_id, CASE WHEN form IN (4, 5) THEN {_sub_sql(K.SUBSTRING_DEFAULT_RULES)} ELSE '' END AS violations FROM b_code)
SELECT doc_id, violations, violations <> '' AS sad_flag FROM s""")
def sec12(spark, sf):
    b = bridge(spark, sf, "b_code")
    return D.scan_with_fallback(b, "code").select("doc_id", F.array_join("violations", ";").alias("violations"),
                                                   "sad_flag")


def _instance(doc_id="doc_id"):
    """A patch of up to three files."""
    return F.concat(F.lit("patch__"), F.expr(f"{doc_id} div 3").cast("string"))


def _sides(spark, sf):
    """(before, after): the code tables of the changed files."""
    b = bridge(spark, sf, "b_code")
    path = F.when(F.col("doc_id") % 7 == 0, F.lit("README.md")).otherwise(F.col("path")).alias("path")
    before = b.where("doc_id % 5 <> 0").select(
        _instance().alias("instance_id"), path, F.when(F.col("doc_id") % 5 <= 2, F.col("notes")).otherwise(F.col("code")).alias("before"))
    after = b.where("doc_id % 11 <> 0").select(_instance().alias("instance_id"), path, F.col("code").alias("after"))
    return before, after


_DELTA = f"""
f AS (SELECT doc_id, 'patch__' || CAST(doc_id // 3 AS VARCHAR) AS instance_id, path, form,
             CASE WHEN doc_id % 5 IN (3, 4) AND form <> 4 THEN {_FOUND} END AS bv,
             CASE WHEN doc_id % 11 <> 0 AND form <> 4 THEN {_FOUND} END AS av,
             CASE WHEN form = 4 AND doc_id % 5 IN (3, 4) THEN 'before-scan failed for ' || path || ': {_NO_LEN}'
                  WHEN form = 4 AND doc_id % 11 <> 0 THEN 'after-scan failed for ' || path || ': {_NO_LEN}' END AS err
      FROM b_code WHERE doc_id % 7 <> 0 AND (doc_id % 5 <> 0 OR doc_id % 11 <> 0)),
d AS (SELECT *, CASE WHEN err IS NULL AND av IS DISTINCT FROM bv THEN av END AS nv FROM f)"""


@register("sec14_postapply_delta", oracle_cte("b_code") + "," + _DELTA + """
SELECT instance_id, coalesce(string_agg(DISTINCT nv, ';' ORDER BY nv), '') AS new_violations,
       count(err) > 0 AS scan_failed, max_by(err, path) FILTER (err IS NOT NULL) AS scan_error,
       count(*) AS n_files, CASE WHEN count(err) > 0 THEN 'FAILED' ELSE 'OK' END AS status
FROM d GROUP BY instance_id""")
def sec14(spark, sf):
    before, after = _sides(spark, sf)
    r = D.postapply_reports(J.before_after(before, after))
    return r.select("instance_id", F.array_join("new_violations", ";").alias("new_violations"), "scan_failed",
                    "scan_error", "n_files", D.report_status(F.lit(False), F.col("scan_failed")).alias("status"))


@register("jn14_before_after", oracle_cte("b_code") + "," + _DELTA + """
SELECT instance_id, path, coalesce(bv, '') AS before, CASE WHEN err LIKE 'before%' THEN '' ELSE coalesce(av, '') END AS after,
       coalesce(nv, '') AS new FROM d""")
def jn14(spark, sf):
    before, after = _sides(spark, sf)
    d = D.file_deltas(J.before_after(before, after))
    return d.select("instance_id", "path", F.array_join("before_violations", ";").alias("before"),
                    F.array_join("after_violations", ";").alias("after"), F.array_join("new_violations", ";").alias("new"))


@register("sec16_task_scan_union", oracle_cte("b_code") + f""",
s AS (SELECT 'task__' || CAST(doc_id // 4 AS VARCHAR) AS task,
             CASE WHEN form IN (4, 5) THEN {_sub_sql(K.RULE_FAMILIES)} ELSE {_FOUND} END AS v FROM b_code)
SELECT task, coalesce(string_agg(DISTINCT v, ';' ORDER BY v) FILTER (v <> ''), '') AS violations FROM s GROUP BY task""")
def sec16(spark, sf):
    b = bridge(spark, sf, "b_code").withColumn("task", F.concat(F.lit("task__"), F.expr("doc_id div 4").cast("string")))
    s = D.scan_with_fallback(b, "code", active=list(K.RULE_FAMILIES))
    return D.distinct_findings(s, "task", "violations").select("task", F.array_join("violations", ";").alias("violations"))


# ------------------------------------------------------------------ JN-5, 6, 7, 8, 9, 10, 13
@register("jn05_dataset_index", oracle_cte("b_preds", "b_index") + """
SELECT p.seq, p.instance_id, i.repo, i.base_commit, i.instance_id IS NULL AS scan_failed,
       CASE WHEN i.instance_id IS NULL THEN 'instance not found in dataset' END AS scan_error
FROM b_preds p LEFT JOIN b_index i ON i.instance_id = p.instance_id""")
def jn05(spark, sf):
    p = bridge(spark, sf, "b_preds").select("seq", "instance_id")
    return J.attach_dataset(p, bridge(spark, sf, "b_index"))


@register("jn06_outcome_resolution", oracle_cte("b_preds", "b_evalreport", "b_evallogs") + f""",
rep AS (SELECT instance_id, CASE WHEN patch_applied = false THEN false ELSE coalesce(resolved, false) END AS resolved,
               CASE WHEN patch_applied = false THEN 'PATCH_APPLY_FAILED'
                    WHEN coalesce(resolved, false) THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolved_status
        FROM b_evalreport),
lg0 AS (SELECT 'doc__' || CAST(conv_id * 10 + turn AS VARCHAR) AS instance_id, log_text FROM b_evallogs),
lg AS (SELECT instance_id,
              CASE WHEN {' OR '.join(f'contains(log_text, {q(m)})' for m in K.PATCH_APPLY_MARKERS)} THEN false
                   ELSE regexp_extract(log_text, {q('resolved:' + K.PY_WS + '*(True|False)')}, 1) = 'True' END AS resolved,
              CASE WHEN {' OR '.join(f'contains(log_text, {q(m)})' for m in K.PATCH_APPLY_MARKERS)} THEN 'PATCH_APPLY_FAILED'
                   WHEN regexp_matches(log_text, {q('resolved:' + K.PY_WS + '*(True|False)')}) THEN
                     CASE WHEN regexp_extract(log_text, {q('resolved:' + K.PY_WS + '*(True|False)')}, 1) = 'True'
                          THEN 'RESOLVED' ELSE 'UNRESOLVED' END END AS resolved_status
       FROM lg0)
SELECT p.instance_id,
       coalesce(CASE WHEN rep.resolved_status IS NOT NULL THEN rep.resolved
                     WHEN lg.resolved_status IS NOT NULL THEN lg.resolved END, false) AS resolved,
       coalesce(rep.resolved_status, lg.resolved_status, 'UNRESOLVED') AS resolved_status
FROM b_preds p LEFT JOIN rep ON rep.instance_id = p.instance_id LEFT JOIN lg ON lg.instance_id = p.instance_id""")
def jn06(spark, sf):
    from gavel.functions.metrics import report_outcome
    p = bridge(spark, sf, "b_preds").select("instance_id")
    r = bridge(spark, sf, "b_evalreport")
    rep = r.select("instance_id", F.when(F.col("patch_applied").eqNullSafe(F.lit(False)), F.lit(False))
                   .otherwise(F.coalesce("resolved", F.lit(False))).alias("resolved"),
                   report_outcome("resolved", "patch_applied").alias("resolved_status"))
    lg = bridge(spark, sf, "b_evallogs").select(
        F.concat(F.lit("doc__"), (F.col("conv_id") * 10 + F.col("turn")).cast("string")).alias("instance_id"),
        TX.classify_eval_log("log_text").alias("c")).select("instance_id", "c.resolved", "c.resolved_status")
    return J.resolve_outcomes(p, rep, lg)


@register("jn07_traj_diagnostics", oracle_cte("b_traj") + """
SELECT instance_id, CAST(strlen(submission) AS BIGINT) AS traj_bytes,
       CAST(strlen(coalesce(CASE WHEN conv_id % 2 = 0 THEN submission END, '')) AS BIGINT) AS pred_bytes,
       contains(coalesce(CASE WHEN conv_id % 2 = 0 THEN submission END, ''), 'diff --git')
         OR (regexp_matches(coalesce(CASE WHEN conv_id % 2 = 0 THEN submission END, ''), '(?m)^--- ')
             AND regexp_matches(coalesce(CASE WHEN conv_id % 2 = 0 THEN submission END, ''), '(?m)^[+][+][+] '))
         AS pred_is_diff
FROM b_traj""")
def jn07(spark, sf):
    t = bridge(spark, sf, "b_traj")
    preds = t.where(F.col("conv_id") % 2 == 0).select("instance_id", F.col("submission").alias("model_patch"))
    return J.traj_diagnostics(t.select("instance_id", "submission"), preds)


@register("jn08_candidate_grid", oracle_cte("b_preds") + """,
pc AS (SELECT instance_id, 'cand_' || CAST(seq % 3 AS VARCHAR) AS candidate_dir, model_patch AS patch
       FROM b_preds WHERE seq % 5 <> 0),
ids AS (SELECT DISTINCT instance_id FROM pc),
dirs(candidate_dir) AS (VALUES ('cand_0'), ('cand_1'), ('cand_2'))
SELECT ids.instance_id, dirs.candidate_dir, CAST(strlen(coalesce(pc.patch, '')) AS BIGINT) AS patch_bytes
FROM ids CROSS JOIN dirs LEFT JOIN pc ON pc.instance_id = ids.instance_id AND pc.candidate_dir = dirs.candidate_dir""")
def jn08(spark, sf):
    p = bridge(spark, sf, "b_preds").where(F.col("seq") % 5 != 0).select(
        "instance_id", F.concat(F.lit("cand_"), (F.col("seq") % 3).cast("string")).alias("candidate_dir"),
        F.col("model_patch").alias("patch"))
    g = J.candidate_grid(p, ["cand_0", "cand_1", "cand_2"])
    return g.select("instance_id", "candidate_dir", F.octet_length("patch").cast("bigint").alias("patch_bytes"))


_MODELS, _CONFIGS, _REPS = ["model-a", "model-b"], ["baseline", "-SAD", "full"], 2


def _instances(spark, sf):
    from gavel.sources.files import subset_lines
    return subset_lines(bridge(spark, sf, "b_subset"), "line").withColumnRenamed("id", "instance")


_SUBSET_SQL = f"""
inst AS (SELECT {Q.strip('line')} AS instance FROM b_subset WHERE {Q.strip('line')} <> '' AND NOT starts_with({Q.strip('line')}, '#')),
m AS (SELECT mo.model, c.config, r.rep, inst.instance FROM inst
      CROSS JOIN (VALUES ('model-a'), ('model-b')) mo(model)
      CROSS JOIN (VALUES ('baseline'), ('-SAD'), ('full')) c(config) CROSS JOIN (VALUES (1), (2)) r(rep)),
mk AS (SELECT *, model || '|' || config || '|' || instance || '|r' || CAST(rep AS VARCHAR) AS key FROM m)"""


@register("jn13_experiment_matrix", oracle_cte("b_subset") + "," + _SUBSET_SQL + """
SELECT model, config, CAST(rep AS INTEGER) AS rep, instance, key,
       replace(model, '/', '_') || '_' || replace(config, '-', 'no') || '_r' || CAST(rep AS VARCHAR) || '_'
       || replace(instance, '/', '_') AS run_label FROM mk""")
def jn13(spark, sf):
    return J.experiment_matrix(_instances(spark, sf), _MODELS, _CONFIGS, _REPS).select(
        "model", "config", "rep", "instance", "key", "run_label")


@register("jn09_pending_runs", oracle_cte("b_subset", "b_state") + "," + _SUBSET_SQL + """
SELECT key FROM mk WHERE key NOT IN (SELECT key FROM b_state WHERE status = 'done')""")
def jn09(spark, sf):
    m = J.experiment_matrix(_instances(spark, sf), _MODELS, _CONFIGS, _REPS)
    done = bridge(spark, sf, "b_state").where(F.col("status") == "done")
    return J.skip_existing(m.select("key"), done, "key")


@register("agg08_ablation_summary", oracle_cte("b_subset", "b_state") + "," + _SUBSET_SQL + """
SELECT CAST((SELECT count(*) FROM b_state WHERE status = 'done') AS BIGINT) AS completed_runs,
       CAST((SELECT count(DISTINCT model) FROM mk) AS BIGINT) AS n_models,
       CAST((SELECT count(DISTINCT config) FROM mk) AS BIGINT) AS n_configs,
       CAST((SELECT count(DISTINCT instance) FROM mk) AS BIGINT) AS n_instances,
       CAST((SELECT count(*) FROM mk) AS BIGINT) AS planned_runs""")
def agg08(spark, sf):
    m = J.experiment_matrix(_instances(spark, sf), _MODELS, _CONFIGS, _REPS)
    st = bridge(spark, sf, "b_state").agg(F.count_if(F.col("status") == "done").cast("bigint").alias("completed_runs"))
    ms = m.agg(F.count_distinct("model").cast("bigint").alias("n_models"),
               F.count_distinct("config").cast("bigint").alias("n_configs"),
               F.count_distinct("instance").cast("bigint").alias("n_instances"),
               F.count(F.lit(1)).cast("bigint").alias("planned_runs"))
    # two one-row aggregates combined with a scalar subquery (no join)
    return spark.sql("SELECT (SELECT completed_runs FROM {st}) AS completed_runs, * FROM {ms}", st=st, ms=ms)


@register("jn10_rerun_split", oracle_cte("b_status_raw") + """,
st AS (SELECT instance_id, status FROM b_status_raw WHERE instance_id IS NOT NULL AND status IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY file DESC, ts DESC, pos DESC) = 1)
SELECT instance_id, status, regexp_matches(instance_id, '^doc__1[0-9]*$') AS removed FROM st""")
def jn10(spark, sf):
    from gavel.sources.files import merge_statuses
    st = merge_statuses(bridge(spark, sf, "b_status_raw"), order=("file", "ts", "pos"))
    return J.rerun_marked(st, F.col("instance_id").rlike(r"^doc__1[0-9]*$"))


# ------------------------------------------------------------------ AGG-13
@register("agg13_traj_counts", oracle_cte("b_traj") + f""",
x AS (SELECT submission, CASE WHEN contains(submission, 'diff --git') OR (regexp_matches(submission, '(?m)^--- ')
                AND regexp_matches(submission, '(?m)^[+][+][+] '))
             THEN regexp_replace(submission, {q(K.PY_WS + '+\\z')}, '') || chr(10) ELSE '' END AS patch FROM b_traj)
SELECT CAST(count(*) AS BIGINT) AS trajectories, CAST(count(*) FILTER (WHERE patch <> '') AS BIGINT) AS with_patch,
       CAST(sum(strlen(submission)) AS BIGINT) AS traj_bytes, CAST(sum(strlen(patch)) AS BIGINT) AS patch_bytes
FROM x""")
def agg13(spark, sf):
    t = bridge(spark, sf, "b_traj")
    patch = F.when(X.looks_like_diff("submission"), F.concat(X.py_rstrip("submission"), F.lit("\n"))).otherwise(F.lit(""))
    return t.select("submission", patch.alias("patch")).agg(
        F.count(F.lit(1)).cast("bigint").alias("trajectories"),
        F.count_if(F.col("patch") != "").cast("bigint").alias("with_patch"),
        F.sum(F.octet_length("submission")).cast("bigint").alias("traj_bytes"),
        F.sum(F.octet_length("patch")).cast("bigint").alias("patch_bytes"))


# ------------------------------------------------------------------ JSN-1..3
def _duck_hmac(msg: str) -> str:
    ipad, opad = C._pads(DEMO_KEY.encode())
    return f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || encode({msg}))))"


_CANON_SQL = ("'{\"model\":' || to_json(model) || ',\"seq\":' || CAST(seq AS VARCHAR) || ',\"task\":' || to_json(task)"
              " || ',\"tests\":{\"passed\":' || CAST(tests_passed AS VARCHAR) || ',\"total\":'"
              " || CAST(total_tests AS VARCHAR) || '},\"type\":' || to_json(type) || '}'")


@register("jsn01_03_canonical_signed", oracle_cte("b_loop") + f""",
c AS (SELECT seq, {_CANON_SQL} AS payload FROM b_loop)
SELECT seq, payload, sha256(payload) AS payload_hash, {_duck_hmac('payload')} AS signature FROM c""")
def jsn01(spark, sf):
    b = bridge(spark, sf, "b_loop")
    payload = C.canonical_json({"model": F.col("model"), "seq": F.col("seq"), "task": F.col("task"),
                                "type": F.col("type"),
                                "tests": {"passed": F.col("tests_passed"), "total": F.col("total_tests")}})
    return (b.select("seq", payload.alias("payload"))
            .withColumn("payload_hash", F.sha2("payload", 256))
            .withColumn("signature", C.hmac_sha256_hex(DEMO_KEY, F.col("payload"))))


_STAMP = "2024-01-01T00:00:00+00:00"


@register("jsn04_proofcards", oracle_cte("b_eval") + f""",
c AS (SELECT task AS instance_id, '{{"cri":' || coalesce(CAST(cri AS VARCHAR), 'null') || ',"decision":"'
        || coalesce(final_decision, 'UNKNOWN') || '","instance_id":"' || task || '","model":"' || model
        || '","patch_hash":null,"proofcard_id":"' || sha256('bench-run|' || task)
        || '","run_id":"bench-run","sad_flag":' || CASE WHEN sad_flag THEN 'true' ELSE 'false' END
        || ',"source_enriched_path":"table","tau":null,"tests":{{"failed":0,"passed":0,"total":0}},"timestamp":"{_STAMP}"}}'
        AS payload FROM b_eval)
SELECT instance_id, payload, sha256(payload) AS payload_hash, 'HMAC-SHA256' AS algo, 'bridge.key' AS key_hint,
       {_duck_hmac('payload')} AS signature FROM c""")
def jsn04(spark, sf):
    from gavel.operators.cards import proofcards
    cards = proofcards(bridge(spark, sf, "b_eval"), run_id="bench-run", stamp=_STAMP, sign_key=DEMO_KEY.encode(),
                       key_hint="bridge.key")
    return cards.select("instance_id", "payload", "payload_hash", "signature.algo", "signature.key_hint",
                        F.col("signature.value").alias("signature"))


# ------------------------------------------------------------------ TXT-2, TXT-26, MET-5, WIN-7, AGG-14
def _dedent_oracle():
    ctes, last = Q.dedent_ctes("b_preds", "model_patch", "seq")
    return f"{oracle_cte('b_preds')},\n{ctes}\nSELECT seq, ded FROM {last}"


@register("txt02_safe_dedent", _dedent_oracle())
def txt02(spark, sf):
    p = bridge(spark, sf, "b_preds").select("seq", "model_patch")
    return X.with_safe_dedent(p, "model_patch", "ded").select("seq", "ded")


@register("txt26_context_packing", oracle_cte("b_ctxfiles") + """,
f AS (SELECT *, max(CASE WHEN kind = 'explicit' THEN 1 ELSE 0 END) OVER (PARTITION BY instance_id) > 0 AS has_exp
      FROM b_ctxfiles),
parts AS (
  SELECT instance_id, 0 AS sec, pos, path, content FROM f WHERE kind = 'explicit'
  UNION ALL
  SELECT instance_id, 1, pos, path, content FROM (
    SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY pos) AS rn FROM f
    WHERE kind = 'changed' AND NOT has_exp AND ends_with(path, '.py')) c WHERE rn <= 5
  UNION ALL
  SELECT instance_id, 2, rn, path, content FROM (
    SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY path) AS rn FROM f WHERE kind = 'test') t
  WHERE rn <= 3)
SELECT instance_id,
       string_agg(CASE WHEN sec = 2 THEN '=== ' || path || ' (tests) ===' || chr(10) || content || chr(10)
                       ELSE '=== ' || path || ' ===' || chr(10) || content || chr(10) END, chr(10) ORDER BY sec, pos)
         AS context
FROM parts GROUP BY instance_id""")
def txt26(spark, sf):
    from gavel.operators.ordered import pack_context
    return pack_context(bridge(spark, sf, "b_ctxfiles"))


@register("met05_normalize_resolved", oracle_cte("b_results") + f"""
SELECT instance_id,
       CASE WHEN resolved_status IS NOT NULL AND {Q.strip('resolved_status')} <> '' THEN
              CASE WHEN lower({Q.strip('resolved_status')}) IN ('resolved', 'pass', 'passed') THEN 'resolved'
                   ELSE 'unresolved' END
            WHEN resolved IS NOT NULL THEN CASE WHEN resolved THEN 'resolved' ELSE 'unresolved' END END AS normalized
FROM b_results""")
def met05(spark, sf):
    from gavel.functions.metrics import normalize_resolved
    b = bridge(spark, sf, "b_results")
    return b.select("instance_id", normalize_resolved("resolved_status", "resolved").alias("normalized"))


@register("win07_newest_pick", oracle_cte("b_status_raw") + """
SELECT instance_id AS key, file || '#' || CAST(pos AS VARCHAR) AS path FROM b_status_raw
QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY ts DESC, file || '#' || CAST(pos AS VARCHAR) DESC) = 1""")
def win07(spark, sf):
    from gavel.operators.ordered import newest
    b = bridge(spark, sf, "b_status_raw").select(
        F.col("instance_id").alias("key"), F.concat("file", F.lit("#"), F.col("pos").cast("string")).alias("path"),
        F.col("ts").alias("mtime"))
    return newest(b, "key")


@register("agg14_calibration", oracle_cte("b_eval") + """,
e AS (SELECT least(floor(coalesce(cri, 0.0) * 10), 9) AS bin, coalesce(cri, 0.0) AS cri,
             CASE WHEN resolved THEN 1.0 ELSE 0.0 END AS y FROM b_eval WHERE resolved IS NOT NULL),
b AS (SELECT bin, count(*) AS n, sum(cri) AS sc, sum(y) AS sy FROM e GROUP BY bin)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(sc - sy)) / sum(n), 6) AS ece FROM b""")
def agg14b(spark, sf):
    from gavel.operators.aggregates import calibration
    return calibration(bridge(spark, sf, "b_eval")).withColumn("ece", F.round("ece", 6))


ALPHAS = ["0.01", "0.05", "0.1", "0.25"]


@register("agg14_conformal", oracle_cte("b_eval") + """,
e AS (SELECT coalesce(CAST(cri AS DOUBLE), 0.0) AS cri, resolved FROM b_eval WHERE resolved IS NOT NULL),
w AS (SELECT cri, row_number() OVER (ORDER BY cri DESC) AS r FROM e WHERE NOT resolved),
t AS (SELECT count(*) AS n, count(*) FILTER (NOT resolved) AS n_wrong FROM e),
a(alpha, d) AS (VALUES """ + ", ".join(f"('{a}', CAST({a} AS DECIMAL(9,4)))" for a in ALPHAS) + """),
k AS (SELECT alpha, n, n_wrong, CAST(floor(d * (n + 1)) AS BIGINT) AS rank FROM a, t),
x AS (SELECT alpha, n, n_wrong, CASE WHEN rank < 1 THEN 'Infinity'::DOUBLE WHEN rank > n_wrong THEN '-Infinity'::DOUBLE ELSE w.cri END AS tau
      FROM k LEFT JOIN w ON w.r = k.rank)
SELECT alpha, n, n_wrong, tau, CAST(count(*) FILTER (e.cri > tau) AS BIGINT) AS accepted,
       CAST(count(*) FILTER (e.cri > tau AND NOT e.resolved) AS BIGINT) AS wrong_accepted
FROM x, e GROUP BY alpha, n, n_wrong, tau""")
def agg14c(spark, sf):
    from gavel.operators.aggregates import conformal_thresholds
    return conformal_thresholds(bridge(spark, sf, "b_eval"), ALPHAS)


# ------------------------------------------------------------------ SRC-15 + SEC-9 gate
_CAT_SQL = ", ".join("(%d, '%s', [%s])" % (i, n, ", ".join(f"'{r}'" for r in rules))
                     for i, (n, _lang, rules) in enumerate(K.TASK_CATALOGUE))


@register("src15_task_rule_gate", oracle_cte("b_code") + f""",
cat(idx, name, security_rules) AS (VALUES {_CAT_SQL}),
c AS (SELECT b.doc_id, cat.name AS task, b.code, cat.security_rules AS rules
      FROM b_code b JOIN cat ON cat.idx = b.doc_id % 11)
SELECT doc_id, task, {_rule_sql()} AS findings FROM c""")
def src15(spark, sf):
    from gavel.sources.files import task_catalogue
    cat = F.broadcast(task_catalogue(spark))  # fixed 11 rows
    b = bridge(spark, sf, "b_code").withColumn("idx", (F.col("doc_id") % 11).cast("int"))
    j = b.join(cat, "idx", "inner")
    return j.select("doc_id", F.col("name").alias("task"),
                    F.array_join(S.rule_findings("code", F.col("security_rules")), ";").alias("findings"))
