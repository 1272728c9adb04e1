"""Registered queries of the file parsers (SRC-1..8, 11) and of the candidate
selection that reads their rows: the inputs are file texts built from the given
tables; each oracle knows what its forms hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gavel import constants as K
from gavel.plans.sqltext import q
from gavel.session import ensure_checkpoint_dir
from gavel.sources import files as S
from gavel.sources.bridges import bridge, oracle_cte

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, oracle):
    def deco(fn):
        QUERIES[name], ORACLE[name] = fn, oracle
        return fn
    return deco


def _pred(form, line, pos, ident, patch):
    return (f"SELECT file, {line} AS line, {pos} AS pos, {ident} AS instance_id, {patch} AS model_patch "
            f"FROM b_predfiles WHERE doc_id % 8 = {form}")


@register("src01_predictions", oracle_cte("b_predfiles") + "\n" + "\nUNION ALL ".join([
    _pred(0, 0, 1, "'a' || doc_id", "t"), _pred(0, 0, 2, "'instance_2'", "t"), _pred(0, 0, 3, "'t' || doc_id", "''"),
    _pred(1, 0, 1, "'m' || doc_id", "t"), _pred(1, 0, 2, "'n' || doc_id", "t"), _pred(2, 0, 0, "'s' || doc_id", "t"),
    _pred(3, 1, 0, "'l' || doc_id", "t"), _pred(3, 3, 0, "'line_3'", "''"), _pred(3, 4, 1, "'p' || doc_id", "''"),
    _pred(3, 4, 2, "'instance_2'", "'0'"), _pred(3, 5, 1, "'k' || doc_id", "t"), _pred(4, 0, 0, "'instance_unknown'", "t"),
    _pred(7, 0, 0, "'0'", "t")]))
def src01(spark, sf):
    return S.parse_prediction_texts(bridge(spark, sf, "b_predfiles").select("file", "text")).select(
        "file", "seq.line", "seq.pos", "instance_id", "model_patch")


@register("src03_exit_statuses", oracle_cte("b_statusfiles") + """,
x AS (SELECT f.*, 'doc__' || (f.doc_id % 300) AS a, d.lang, d.source FROM b_statusfiles f JOIN documents d USING (doc_id)),
w AS (SELECT file, 0 AS pos, a AS instance_id, 'Submitted' AS status FROM x WHERE doc_id % 4 = 0
      UNION ALL SELECT file, 1, lang, 'Submitted' FROM x WHERE doc_id % 4 = 0
      UNION ALL SELECT file, 2, lang, 'error' FROM x WHERE doc_id % 4 = 0
      UNION ALL SELECT file, 0, a, source FROM x WHERE doc_id % 4 = 1)
SELECT instance_id, arg_max(status, (file, pos)) AS status FROM w WHERE instance_id IS NOT NULL GROUP BY instance_id""")
def src03(spark, sf):
    return S.merge_statuses(S.status_rows(bridge(spark, sf, "b_statusfiles").select("file", "text")))


@register("src04_last_results", oracle_cte("b_resultlines") + """,
p AS (SELECT line, value FROM b_resultlines WHERE json_valid(value))
SELECT value->>'instance_id' AS instance_id, arg_max(CAST(value->>'resolved' AS BOOLEAN), line) AS resolved,
       arg_max(value->>'resolved_status', line) AS resolved_status, arg_max(value->>'cri', line) AS cri
FROM p WHERE value->>'instance_id' IS NOT NULL GROUP BY 1""")
def src04(spark, sf):
    return S.last_results(S.parse_json_lines(bridge(spark, sf, "b_resultlines"), S.RESULT_SCHEMA))


@register("src05_06_security_reports", oracle_cte("b_reportfiles") + """
SELECT 'doc__' || doc_id AS instance_id, doc_id % 6 >= 4 AS corrupt,
       CASE doc_id % 6 WHEN 0 THEN 'B;A' WHEN 1 THEN 'ONE' ELSE '' END AS violations,
       doc_id % 6 >= 2 AS scan_failed, CASE WHEN doc_id % 6 = 2 THEN 'e' END AS scan_error
FROM b_reportfiles""")
def src05(spark, sf):
    r = S.parse_reports(bridge(spark, sf, "b_reportfiles").select("file", "text"))
    failed = F.col("corrupt") | F.coalesce("scan_failed", F.lit(False)) | ~F.coalesce("scan_ok", F.lit(True))
    return r.select("instance_id", "corrupt", F.array_join(F.coalesce("new_violations", F.array().cast("array<string>")), ";")
                    .alias("violations"), failed.alias("scan_failed"), "scan_error")


@register("src07_trajectories", oracle_cte("b_trajfiles") + f"""
SELECT 'c' || conv_id AS instance_id,
       CASE WHEN conv_id % 7 <> 6 AND (contains(s, 'diff --git') OR (regexp_matches(s, '(?m)^--- ') AND regexp_matches(s, '(?m)^[+][+][+] ')))
            THEN regexp_replace(s, {q(K.PY_WS + '+\\z')}, '') || chr(10) ELSE '' END AS model_patch,
       CASE WHEN conv_id % 7 = 6 THEN 0 ELSE octet_length(encode(s)) END AS submission_bytes
FROM b_trajfiles WHERE conv_id % 7 <> 5""")
def src07(spark, sf):
    return S.parse_trajectories(bridge(spark, sf, "b_trajfiles").select("file", "text")).select(
        "instance_id", "model_patch", "submission_bytes")


@register("src08_evaluator_reports", oracle_cte("b_evalfiles") + """
SELECT file, 'a' AS instance_id, false AS resolved, NULL::BOOLEAN AS patch_successfully_applied FROM b_evalfiles WHERE doc_id % 4 = 0
UNION ALL SELECT file, 'b', true, false FROM b_evalfiles WHERE doc_id % 4 = 0
UNION ALL SELECT file, 't' || doc_id, true, NULL FROM b_evalfiles WHERE doc_id % 4 = 1
UNION ALL SELECT file, 'solo' || doc_id, false, NULL FROM b_evalfiles WHERE doc_id % 4 = 2
UNION ALL SELECT file, 'i' || doc_id, NULL, NULL FROM b_evalfiles WHERE doc_id % 4 = 3""")
def src08(spark, sf):
    return S.parse_evaluator_reports(bridge(spark, sf, "b_evalfiles").select("file", "text"))


@register("src11_json_lines", oracle_cte("b_resultlines") + """
SELECT line, CASE WHEN json_valid(value) THEN value->>'instance_id' END AS instance_id, NOT json_valid(value) AS malformed
FROM b_resultlines WHERE trim(value) <> ''""")
def src11(spark, sf):
    rows = S.parse_json_lines(bridge(spark, sf, "b_resultlines"), S.RESULT_SCHEMA)
    return rows.select("line", "instance_id", F.col("_corrupt_record").isNotNull().alias("malformed"))


@register("src09_newest_logs", oracle_cte("b_listing") + """,
x AS (SELECT *, regexp_extract(path, '/([^/]+)/run_instance[.]log$', 1) AS key FROM b_listing)
SELECT key, path, sha256(text) AS text_sha256 FROM x
WHERE key <> '' AND path = (SELECT max_by(y.path, (y.mtime, y.path)) FROM x y WHERE y.key = x.key)""")
def src09(spark, sf):
    return S.newest_texts(bridge(spark, sf, "b_listing"), S.EVAL_LOG_KEY).select(
        "key", "path", F.sha2("text", 256).alias("text_sha256"))


@register("src10_newest_reports", oracle_cte("b_listing") + """
SELECT regexp_extract(path, '[.]([^./]+)[.]json$', 1) AS key, max_by(path, (mtime, path)) AS path
FROM b_listing WHERE path LIKE '/runs/out/%' GROUP BY 1""")
def src10(spark, sf):
    return S.newest_per_key(bridge(spark, sf, "b_listing").where("path LIKE '/runs/out/%'"), r"\.([^./]+)\.json$")


# fixed values: where a run keeps its artifacts, first existing one counts
ARTIFACTS = {"traj": ["trajs/{id}.traj.json", "trajectories/{id}.traj.json"], "log": ["logs/{id}.log", "logs/{id}.txt"],
             "proofcard": ["proofcards/{id}.json", "proofcards/{id}.proofcard.json"]}
_ARTIFACT_CTES = """,
t(kind, prio, pre, post) AS (VALUES """ + ", ".join(
    f"('{kind}', {n}, '{t.split('{id}')[0]}', '{t.split('{id}')[1]}')" for kind, ts in ARTIFACTS.items() for n, t in enumerate(ts)) + """),
m AS (SELECT kind, prio, substr(path, 7) AS rel, pre, post FROM b_listing JOIN t
      ON starts_with(path, '/runs/' || pre) AND ends_with(path, post)),
a AS (SELECT substr(rel, length(pre) + 1, length(rel) - length(pre) - length(post)) AS instance_id, kind,
             min_by(rel, (prio, rel)) AS path FROM m GROUP BY 1, 2)"""


@register("src14_artifacts", oracle_cte("b_listing") + _ARTIFACT_CTES + "\nSELECT instance_id, kind, path FROM a")
def src14(spark, sf):
    return S.discover_artifacts(bridge(spark, sf, "b_listing").select("path"), "/runs", ARTIFACTS)


@register("jn04_governed_artifacts", oracle_cte("b_listing", "b_preds") + _ARTIFACT_CTES + """
SELECT p.instance_id AS task, p.seq, max(CASE WHEN kind = 'traj' THEN path END) AS traj, max(CASE WHEN kind = 'log' THEN path END) AS log,
       max(CASE WHEN kind = 'proofcard' THEN path END) AS proofcard
FROM b_preds p LEFT JOIN a ON a.instance_id = p.instance_id GROUP BY 1, 2""")
def jn04(spark, sf):
    """The governed evaluation with the artifacts of a listing."""
    from gavel.plans.q_governance import governed_from_bridges

    found = S.discover_artifacts(bridge(spark, sf, "b_listing").select("path"), "/runs", ARTIFACTS)
    rows = governed_from_bridges(spark, sf, artifacts=S.artifact_columns(found, list(ARTIFACTS)))
    return rows.select("task", "seq", "artifacts.*")


@register("src16_prediction_files", oracle_cte("b_listing") + """,
p AS (SELECT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir FROM b_listing WHERE path LIKE '%/preds%.json')
SELECT dir, coalesce(max(CASE WHEN path LIKE '%/preds_filled.json' THEN path END), max(path)) AS path FROM p GROUP BY dir""")
def src16(spark, sf):
    return S.choose_prediction_file(bridge(spark, sf, "b_listing").select("path"))


def _reread(layout, read):
    """Predictions written in one layout and read back."""
    def query(spark, sf):
        from gavel.sinks.documents import write_document

        preds = bridge(spark, sf, "b_preds").select("instance_id", "model_patch", F.col("seq").alias("_seq"))
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents/{uuid.uuid4().hex}/{layout}.json"
        write_document(preds, path, ["_seq"], layout, "instance_id" if layout == "mapping" else None)
        return read(spark, path).select("seq.line", "seq.pos", "instance_id", F.sha2("model_patch", 256).alias("patch_sha256"))
    return query


for _name, _layout, _read, _line, _pos in (
        ("snk08_predictions_array", "array", S.read_predictions_json, 0, "n"),
        ("snk08_predictions_mapping", "mapping", S.read_predictions_json, 0, "n"),
        ("snk01_predictions_lines", "lines", S.read_predictions_jsonl, "n", 0)):
    register(_name, oracle_cte("b_preds") + f""",
p AS (SELECT instance_id, model_patch, row_number() OVER (ORDER BY seq, instance_id, model_patch) AS n FROM b_preds)
SELECT {_line} AS line, {_pos} AS pos, instance_id, sha256(model_patch) AS patch_sha256 FROM p""")(_reread(_layout, _read))


@register("set05_row_differences", oracle_cte("b_preds") + """,
l AS (SELECT instance_id, model_patch FROM b_preds),
r AS (SELECT instance_id, CASE WHEN seq % 50 = 0 THEN model_patch || '!' ELSE model_patch END AS model_patch FROM b_preds WHERE seq % 70 <> 1
      UNION ALL SELECT instance_id, model_patch FROM b_preds WHERE seq % 90 = 2),
n AS (SELECT instance_id, model_patch, sum(side) AS n FROM (SELECT *, 1 AS side FROM l UNION ALL SELECT *, -1 FROM r) GROUP BY 1, 2)
SELECT instance_id, sha256(model_patch) AS patch_sha256, CAST(greatest(n, 0) AS BIGINT) AS only_left, CAST(greatest(-n, 0) AS BIGINT) AS only_right
FROM n WHERE n <> 0""")
def set05(spark, sf):
    """Predictions against a copy with changed, missing and repeated rows."""
    from gavel.operators.ordered import row_differences

    preds = bridge(spark, sf, "b_preds").select("instance_id", "model_patch", "seq")
    changed = F.when(F.col("seq") % 50 == 0, F.concat("model_patch", F.lit("!"))).otherwise(F.col("model_patch"))
    copy = preds.where("seq % 70 <> 1").withColumn("model_patch", changed).unionByName(preds.where("seq % 90 = 2"))
    return row_differences(preds.drop("seq"), copy.drop("seq")).select(
        "instance_id", F.sha2("model_patch", 256).alias("patch_sha256"), "only_left", "only_right")


_RESULT = ("(doc_id + pos) % 2 = 0 AS resolved, 'S' || (doc_id % 3) AS resolved_status, "
           "CASE WHEN pos = 0 THEN '0.' || (doc_id % 9) END AS cri")
_REPORT = "CASE WHEN doc_id % 4 <> 1 THEN 'scope' END AS scan_scope, doc_id % 2 = 0 AS scan_failed"


@register("win01_selection_rows", oracle_cte("b_candfiles") + f""",
g AS (SELECT i.doc_id, 'doc__' || i.doc_id AS instance_id, d.pos, d.candidate_dir, coalesce(c.patch, '') AS patch, coalesce(c.k, 3) AS k
      FROM (SELECT DISTINCT doc_id FROM b_candfiles) i
      CROSS JOIN (VALUES (0, 'cand_a'), (1, 'cand_b'), (2, 'cand_c')) d(pos, candidate_dir)
      LEFT JOIN b_candfiles c ON c.doc_id = i.doc_id AND c.pos = d.pos),
r AS (SELECT doc_id, pos, {_RESULT} FROM b_candfiles WHERE doc_id % 7 <> 3),
p AS (SELECT doc_id, pos, {_REPORT}, CASE WHEN doc_id % 3 = 0 THEN ['X'] ELSE CAST([] AS VARCHAR[]) END AS v FROM b_candfiles WHERE doc_id % 11 = 0),
e AS (SELECT g.*, coalesce(r.resolved, false) AS resolved, r.resolved_status, coalesce(CAST(r.cri AS DOUBLE), 0.0) AS cri,
             p.doc_id IS NOT NULL AS found, coalesce(p.scan_scope, 'postapply_fullfile_delta_v1') AS scan_scope,
             CASE WHEN p.doc_id IS NOT NULL THEN p.v WHEN k = 1 THEN ['[high] {K.SECRET_LABEL}@src/m.py: token = "sk_live_' || g.doc_id || '"']
                  ELSE CAST([] AS VARCHAR[]) END AS v,
             CASE WHEN p.doc_id IS NOT NULL THEN p.scan_failed ELSE k >= 2 END AS failed
      FROM g LEFT JOIN r ON r.doc_id = g.doc_id AND r.pos = g.pos LEFT JOIN p ON p.doc_id = g.doc_id AND p.pos = g.pos),
f AS (SELECT *, CASE WHEN len(v) > 0 THEN 'VETO' WHEN failed THEN 'ABSTAIN' WHEN resolved THEN 'OK' ELSE 'ABSTAIN' END AS final_decision FROM e)
SELECT candidate_dir, instance_id, patch, resolved, resolved_status, cri, array_to_string(v, ';') AS security_violations,
       failed AS security_scan_failed, CASE WHEN found THEN scan_scope ELSE 'diff_fragment_fallback_v2' END AS security_scan_scope,
       len(v) > 0 AS sad_flag, final_decision, CAST(patch <> '' AS BIGINT) AS changed_files, length(patch) AS patch_size,
       found AS security_report_found
FROM f QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY
  CASE WHEN final_decision = 'VETO' THEN 3 WHEN final_decision = 'OK' THEN 0 WHEN resolved THEN 1 ELSE 2 END,
  -cri, (patch <> ''), length(patch), pos) = 1""")
def win01_rows(spark, sf):
    from gavel.operators.ordered import select_candidates

    c = bridge(spark, sf, "b_candfiles")
    key = ["instance_id", "candidate_dir"]
    results = c.where("doc_id % 7 <> 3").selectExpr(*key, *_RESULT.split(", "))
    reports = c.where("doc_id % 11 = 0").selectExpr(
        *key, *_REPORT.split(", "), "CASE WHEN doc_id % 3 = 0 THEN array('X') ELSE CAST(array() AS array<string>) END AS new_violations")
    best = select_candidates(c.select(*key, "patch"), ["cand_a", "cand_b", "cand_c"], results, reports)
    return best.withColumn("security_violations", F.array_join("security_violations", ";"))
