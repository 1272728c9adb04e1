"""Registered queries: text, diff and filter operators (TXT-*, FLT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions import security as S
from gavel.functions import text as X
from gavel.functions import textops as TX
from gavel.operators.prompts import patch_prompts, task_prompts
from gavel.plans import sqltext as Q
from gavel.plans.sqltext import q
from gavel.sources.bridges import bridge, oracle_cte, read_table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, oracle=None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _norm_oracle(select: str, extra_ctes: str = "") -> str:
    norm, last = Q.normalize_ctes("b_preds", "model_patch", "instance_id, seq, model_patch")
    return f"{oracle_cte('b_preds')},\n{norm}{extra_ctes.replace('{last}', last)}\n{select.replace('{last}', last)}"


def _normalized(spark, sf):
    p = bridge(spark, sf, "b_preds")
    return X.with_normalized_patch(p, "model_patch", "patch")


# ------------------------------------------------------------------ TXT-1/2/13
@register("txt01_normalize_patch", _norm_oracle("SELECT seq, patch FROM {last}"))
def txt01(spark, sf):
    return _normalized(spark, sf).select("seq", "patch")


@register("txt13_fingerprint", oracle_cte("b_preds") + """
SELECT seq, CAST(strlen(model_patch) AS BIGINT) AS patch_bytes, sha256(model_patch) AS patch_sha256,
       CASE WHEN model_patch = '' THEN NULL ELSE sha256(model_patch) END AS card_patch_hash FROM b_preds""")
def txt13(spark, sf):
    p = bridge(spark, sf, "b_preds")
    return p.select("seq", X.patch_bytes("model_patch").alias("patch_bytes"),
                    X.patch_sha256("model_patch").alias("patch_sha256"),
                    F.when(F.col("model_patch") != "", X.patch_sha256("model_patch")).alias("card_patch_hash"))


# ------------------------------------------------------------------ TXT-3..6, 8 and SRC-7
def _pred_sql(x: str) -> str:
    markers = f"(regexp_matches({x}, '(?m)^--- ') AND regexp_matches({x}, '(?m)^[+][+][+] '))"
    loose = f"(contains({x}, 'diff --git') OR {markers})"
    full = f"regexp_matches({x}, '(?m)^@@ -\\d+,\\d+ [+]\\d+,\\d+ @@')"
    txt4 = f"(regexp_matches({x}, '(?m)^diff --git') OR ({full} AND {markers}))"
    txt5 = f"(regexp_matches({x}, '(?m)^diff --git') OR regexp_matches({x}, '(?m)^@@') OR {markers})"
    files = f"(regexp_matches({x}, '(?m)^---') AND regexp_matches({x}, '(?m)^[+][+][+]'))"
    txt6 = f"({full} AND (regexp_matches({x}, '(?m)^diff --git') OR {files}))"
    nopatch = f"({Q.strip(x)} = '' OR upper({Q.strip(x)}) = 'NO_PATCH')"
    return (f"{loose} AS looks_like_diff, {txt4} AS looks_like_unified_diff, {txt5} AS looks_like_unified_diff_swe,"
            f" {txt6} AS valid_unified_diff, {nopatch} AS no_patch")


@register("txt03_diff_predicates", oracle_cte("b_traj") + f"""
SELECT conv_id, {_pred_sql('submission')},
       CASE WHEN {_pred_sql('submission').split(' AS ')[0]} THEN regexp_replace(submission, {q(K.PY_WS + '+\\z')}, '') || chr(10) ELSE '' END AS model_patch
FROM b_traj""")
def txt03(spark, sf):
    t = bridge(spark, sf, "b_traj")
    s = F.col("submission")
    return t.select("conv_id", X.looks_like_diff(s).alias("looks_like_diff"),
                    X.looks_like_unified_diff(s).alias("looks_like_unified_diff"),
                    X.looks_like_unified_diff_swe(s).alias("looks_like_unified_diff_swe"),
                    X.validate_unified_diff(s).alias("valid_unified_diff"), X.is_no_patch(s).alias("no_patch"),
                    F.when(X.looks_like_diff(s), F.concat(X.py_rstrip(s), F.lit("\n"))).otherwise(F.lit(""))
                    .alias("model_patch"))


# ------------------------------------------------------------------ TXT-9
_ADDED_CTES = f""",
ln AS (SELECT seq, unnest(string_split(patch, chr(10))) AS line,
              generate_subscripts(string_split(patch, chr(10)), 1) AS pos FROM {{last}}),
lb AS (SELECT *, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY seq ORDER BY pos) AS blk FROM ln),
ls AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ ') THEN
                   regexp_replace(regexp_extract(line, {q('^[+][+][+]' + K.PY_WS + '+(' + K.PY_NONWS + '+)')}, 1), '^b/', '')
                 END IGNORE NULLS) OVER w AS cur_path,
              coalesce(bool_or(starts_with(line, '@@ ')) OVER w, false) AS in_hunk
       FROM lb WINDOW w AS (PARTITION BY seq, blk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("txt09_added_lines", _norm_oracle("""
SELECT seq, CAST(pos - 1 AS INTEGER) AS pos, nullif(cur_path, '') AS path, substring(line, 2) AS line FROM ls
WHERE in_hunk AND starts_with(line, '+') AND NOT starts_with(line, '+++ ')""", _ADDED_CTES))
def txt09(spark, sf):
    rows = X.explode_added_lines(_normalized(spark, sf).select("seq", "patch"), "patch")
    return rows.select("seq", "pos", F.nullif(F.col("path"), F.lit("")).alias("path"), "line")


@register("sec13_secret_findings", _norm_oracle(f"""
SELECT seq, CAST(count(*) AS BIGINT) AS n_code_lines,
       array_to_string(list_sort(list_distinct(flatten(list(
         list_transform(regexp_extract_all(nrm, {q(K.SECRET_RE)}, 2), lambda val:
           '[' || CASE WHEN {Q.is_test_path('cur_path')} OR
                        {' OR '.join(f"contains(lower({Q.strip('val')}), {q(m)})" for m in K.SECRET_DUMMY_MARKERS)}
                   THEN 'info' ELSE 'high' END || '] {K.SECRET_LABEL}'
           || CASE WHEN coalesce(cur_path, '') <> '' THEN '@' || cur_path || ': ' ELSE ': ' END
           || CASE WHEN length(nrm) > 160 THEN substring(nrm, 1, 157) || '...' ELSE nrm END))))), ';') AS light
FROM (SELECT seq, cur_path, {Q.strip('substring(line, 2)')} AS nrm FROM ls
      WHERE in_hunk AND starts_with(line, '+') AND NOT starts_with(line, '+++ ')
        AND substring(line, 2) <> '' AND NOT starts_with({Q.lstrip('substring(line, 2)')}, '#')) c
GROUP BY seq""", _ADDED_CTES))
def sec13(spark, sf):
    scan = S.with_diff_scan(_normalized(spark, sf).select("seq", "patch"), "patch")
    return scan.where("_ds_ncode > 0").select("seq", F.col("_ds_ncode").cast("bigint").alias("n_code_lines"),
                                              F.array_join("_ds_light", ";").alias("light"))


# ------------------------------------------------------------------ TXT-10, 11
@register("txt10_files_in_patch", _norm_oracle("""
SELECT seq, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(patch, chr(10)),
         lambda x: CASE WHEN starts_with(x, '+++') OR starts_with(x, '---') THEN regexp_extract(x, '[ab]/(.+)', 1) END),
         lambda y: y IS NOT NULL AND y <> ''))), ';') AS files,
       CAST(len(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, 'diff --git '))) AS BIGINT)
         AS changed_files
FROM {last}"""))
def txt10(spark, sf):
    n = _normalized(spark, sf)
    return n.select("seq", F.array_join(X.files_in_patch("patch"), ";").alias("files"),
                    X.changed_file_count("patch").cast("bigint").alias("changed_files"))


# ------------------------------------------------------------------ TXT-14..17
@register("txt14_secret_severity", oracle_cte("b_paths") + f"""
SELECT doc_id, {Q.is_test_path('path')} AS is_test,
       CASE WHEN {Q.is_test_path('path')} OR
                 {' OR '.join(f"contains(lower({Q.strip('value')}), {q(m)})" for m in K.SECRET_DUMMY_MARKERS)}
            THEN 'info' ELSE 'high' END AS severity,
       CASE WHEN length(text) > 160 THEN substring(text, 1, 157) || '...' ELSE text END AS snippet
FROM b_paths""")
def txt14(spark, sf):
    b = bridge(spark, sf, "b_paths")
    return b.select("doc_id", X.is_test_path("path").alias("is_test"),
                    X.secret_severity("path", "value").alias("severity"), X.cap_snippet("text").alias("snippet"))


@register("txt16_tag_violations", oracle_cte("b_reports") + f"""
SELECT instance_id, v, {Q.tag('v')} AS tagged, {Q.severity_of('v')} AS severity
FROM (SELECT instance_id, unnest(new_violations) AS v FROM b_reports) x""")
def txt16(spark, sf):
    r = bridge(spark, sf, "b_reports").select("instance_id", F.explode("new_violations").alias("v"))
    return r.select("instance_id", "v", X.tag_violation("v").alias("tagged"),
                    X.violation_severity("v").alias("severity"))


# ------------------------------------------------------------------ TXT-18, FLT-3
@register("txt18_infra_predicates", oracle_cte("b_preds") + f"""
SELECT seq, model_patch <> '' AND contains(lower(model_patch), 'docker') AND regexp_matches(model_patch, {q(K.TIMEOUT_RE)})
         AS infra_docker,
       model_patch <> '' AND regexp_matches(model_patch, {q(K.TIMEOUT_RE)}) AS infra_phrase,
       contains(lower({Q.strip('model_patch')}), 'timed out after') AND contains(lower({Q.strip('model_patch')}), 'seconds')
         AS infra_loose,
       CASE WHEN {Q.strip('model_patch')} = '' THEN 'EMPTY_PATCH'
            WHEN contains(lower({Q.strip('model_patch')}), 'timed out after')
                 AND contains(lower({Q.strip('model_patch')}), 'seconds') THEN 'INFRA_TIMEOUT_BEFORE_PATCH'
            WHEN upper(provider) = 'INFRA_TIMEOUT_BEFORE_PATCH' THEN 'INFRA_TIMEOUT_BEFORE_PATCH' END AS skip_reason
FROM b_preds""")
def txt18(spark, sf):
    from gavel.operators.delta import skip_reason
    p = bridge(spark, sf, "b_preds")
    return p.select("seq", X.infra_timeout_docker("model_patch").alias("infra_docker"),
                    X.infra_timeout_phrase("model_patch").alias("infra_phrase"),
                    X.infra_text_loose("model_patch").alias("infra_loose"),
                    skip_reason(F.col("provider"), F.col("model_patch")).alias("skip_reason"))


# ------------------------------------------------------------------ TXT-19..21
_P = r"(\d+)" + K.PY_WS + r"+passed(?:," + K.PY_WS + r"+(\d+)" + K.PY_WS + r"+failed)?"
_FF = r"(\d+)" + K.PY_WS + r"+failed," + K.PY_WS + r"+(\d+)" + K.PY_WS + r"+passed"


@register("txt19_test_output", oracle_cte("b_testlogs") + f""",
x AS (SELECT log_id, output,
             regexp_matches(output, {q(_P)}) AS m1, CAST(nullif(regexp_extract(output, {q(_P)}, 1), '') AS BIGINT) AS p1,
             coalesce(CAST(nullif(regexp_extract(output, {q(_P)}, 2), '') AS BIGINT), 0) AS f1,
             regexp_matches(output, 'FAILED.*failures=(\\d+)') AS m2,
             CAST(nullif(regexp_extract(output, 'FAILED.*failures=(\\d+)', 1), '') AS BIGINT) AS f2,
             regexp_matches(output, {q(_FF)}) AS m3,
             CAST(nullif(regexp_extract(output, {q(_FF)}, 1), '') AS BIGINT) AS f3,
             CAST(nullif(regexp_extract(output, {q(_FF)}, 2), '') AS BIGINT) AS p3
      FROM b_testlogs)
SELECT log_id,
       CAST(CASE WHEN m1 THEN p1 + f1 WHEN m2 THEN f2 WHEN m3 THEN p3 + f3
                 WHEN contains(lower(output), 'passed') AND NOT contains(lower(output), 'fail') THEN 1 ELSE 1 END AS BIGINT)
         AS total_tests,
       CAST(CASE WHEN m1 THEN f1 WHEN m2 THEN f2 WHEN m3 THEN f3
                 WHEN contains(lower(output), 'passed') AND NOT contains(lower(output), 'fail') THEN 0 ELSE 1 END AS BIGINT)
         AS tests_failed,
       CAST(CASE WHEN m1 THEN p1 + f1 WHEN m2 THEN f2 ELSE 1 END AS BIGINT) AS sandbox_total,
       CAST(CASE WHEN m1 THEN f1 WHEN m2 THEN f2 ELSE 1 END AS BIGINT) AS sandbox_failed
FROM x""")
def txt19(spark, sf):
    b = bridge(spark, sf, "b_testlogs")
    return b.select("log_id", TX.parse_test_output("output").alias("r"),
                    TX.parse_test_output("output", sandbox=True).alias("s")).select(
        "log_id", "r.total_tests", "r.tests_failed", F.col("s.total_tests").alias("sandbox_total"),
        F.col("s.tests_failed").alias("sandbox_failed"))


@register("txt20_eval_log_classify", oracle_cte("b_evallogs") + f"""
SELECT conv_id, turn,
       CASE WHEN {' OR '.join(f'contains(log_text, {q(m)})' for m in K.PATCH_APPLY_MARKERS)} THEN false
            WHEN regexp_matches(log_text, {q('resolved:' + K.PY_WS + '*(True|False)')})
            THEN regexp_extract(log_text, {q('resolved:' + K.PY_WS + '*(True|False)')}, 1) = 'True' END AS resolved,
       CASE WHEN {' OR '.join(f'contains(log_text, {q(m)})' for m in K.PATCH_APPLY_MARKERS)} THEN 'PATCH_APPLY_FAILED'
            WHEN regexp_matches(log_text, {q('resolved:' + K.PY_WS + '*(True|False)')}) THEN
              CASE WHEN regexp_extract(log_text, {q('resolved:' + K.PY_WS + '*(True|False)')}, 1) = 'True'
                   THEN 'RESOLVED' ELSE 'UNRESOLVED' END END AS resolved_status
FROM b_evallogs""")
def txt20(spark, sf):
    b = bridge(spark, sf, "b_evallogs")
    return b.select("conv_id", "turn", TX.classify_eval_log("log_text").alias("c")).select(
        "conv_id", "turn", "c.resolved", "c.resolved_status")


@register("txt21_linter_lines", oracle_cte("b_testlogs") + f"""
SELECT log_id, CAST(CASE WHEN exit_code = 0 AND {Q.strip('output')} = '' THEN 0
                         ELSE len(list_filter(string_split(output, chr(10)), lambda x: {Q.strip('x')} <> '')) END AS BIGINT)
                AS n_lint
FROM b_testlogs""")
def txt21(spark, sf):
    b = bridge(spark, sf, "b_testlogs")
    return b.select("log_id", F.size(TX.linter_lines("exit_code", "output")).cast("bigint").alias("n_lint"))


# ------------------------------------------------------------------ TXT-22..24, 27
@register("txt22_safe_names", oracle_cte("b_loop") + f"""
SELECT DISTINCT model, regexp_replace({Q.strip("model || '/' || task")}, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe
FROM b_loop""")
def txt22(spark, sf):
    b = bridge(spark, sf, "b_loop")
    return b.select("model", TX.safe_name(F.concat("model", F.lit("/"), "task")).alias("safe")).distinct()


@register("txt23_next_run_index", oracle_cte("b_loop") + """
SELECT model AS prefix, CAST(coalesce(max(CAST(nullif(regexp_extract(name, '_run(\\d+)', 1), '') AS BIGINT)), 0) + 1 AS BIGINT)
       AS next_index
FROM (SELECT model, 'results_' || task || '_run' || CAST(seq % 37 AS VARCHAR) || '.jsonl' AS name FROM b_loop) n
GROUP BY model""")
def txt23(spark, sf):
    b = bridge(spark, sf, "b_loop").select(
        "model", F.concat(F.lit("results_"), "task", F.lit("_run"), (F.col("seq") % 37).cast("string"),
                          F.lit(".jsonl")).alias("name"))
    return b.groupBy(F.col("model").alias("prefix")).agg(
        (F.coalesce(F.max(TX.run_index("name")), F.lit(0)) + 1).cast("bigint").alias("next_index"))


@register("txt27_prompt_tail", oracle_cte("b_paths") + """
SELECT doc_id, CASE WHEN length(text) > 4000 THEN right(text, 4000) ELSE text END AS prompt FROM b_paths""")
def txt27(spark, sf):
    return bridge(spark, sf, "b_paths").select("doc_id", TX.tail("text", 4000).alias("prompt"))


# ------------------------------------------------------------------ TXT-25
@register("txt25_prompts", oracle_cte("b_paths") + """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN
  'Task: ' || path || chr(10) || 'Language: python' || chr(10) || chr(10) || 'Specification:' || chr(10) || value
  || chr(10) || chr(10) || 'Starter code (you MAY reuse or refactor):' || chr(10) || '```python' || chr(10) || ''
  || chr(10) || '```' || chr(10) || chr(10) || 'Write a complete, working solution in one file. Return ONLY the final code.'
ELSE
  'Task: ' || path || chr(10) || 'Language: python' || chr(10) || chr(10) || 'Specification:' || chr(10) || value
  || chr(10) || chr(10) || 'You wrote the following code which FAILED tests or checks:' || chr(10) || '```python'
  || chr(10) || 'pass' || chr(10) || '```' || chr(10) || chr(10) || 'Test / linter / security output:' || chr(10)
  || '1 failed' || chr(10) || 'Linter errors: [' || chr(39) || 'E501' || chr(39) || ']' || chr(10)
  || 'Security violations: []' || chr(10) || chr(10)
  || 'Repair the code. Focus on fixing failing tests and security issues. Return ONLY the corrected code.' END AS prompt
FROM b_paths""")
def txt25(spark, sf):
    b = bridge(spark, sf, "b_paths")
    odd = F.col("doc_id") % 2 == 1
    prompt = TX.build_prompt(F.col("path"), F.lit("python"), F.col("value"), F.lit(""),
                             previous=F.when(odd, F.lit("pass")), output=F.lit("1 failed"),
                             lint=F.array(F.lit("E501")), viol=F.array().cast("array<string>"))
    return b.select("doc_id", prompt.alias("prompt"))


_LAST = """,
s AS (SELECT 'doc__' || doc_id AS task, 'task ' || doc_id AS name, text AS spec, doc_id FROM documents),
l AS (SELECT task, max(step) AS step FROM b_attempts_code GROUP BY task),
c AS (SELECT b.* FROM b_attempts_code b JOIN l USING (task, step)),
j AS (SELECT s.*, c.step, c.code, coalesce(c.output, '') AS output, c.lint, c.viol FROM s LEFT JOIN c USING (task))"""


def _prompt_inputs(spark, sf):
    docs = read_table(spark, sf, "documents")
    task = F.concat(F.lit("doc__"), F.col("doc_id").cast("string"))
    specs = docs.select(task.alias("task"), F.concat(F.lit("task "), F.col("doc_id").cast("string")).alias("name"),
                        F.lit("python").alias("language"), F.col("text").alias("spec"))
    return docs, task, specs, bridge(spark, sf, "b_attempts_code")


@register("txt25_task_prompts", oracle_cte("b_attempts_code") + _LAST + """
SELECT task, CASE WHEN step IS NULL THEN
  format(E'Task: {}\\nLanguage: python\\n\\nSpecification:\\n{}\\n\\nStarter code (you MAY reuse or refactor):\\n```python\\n{}\\n```\\n\\n', name, spec,
         CASE WHEN doc_id % 3 = 0 THEN 'start ' || doc_id ELSE '' END) || 'Write a complete, working solution in one file. Return ONLY the final code.'
ELSE format(E'Task: {}\\nLanguage: python\\n\\nSpecification:\\n{}\\n\\nYou wrote the following code which FAILED tests or checks:\\n```python\\n{}\\n```\\n\\nTest / linter / security output:\\n{}\\n',
            name, spec, code, output)
  || 'Linter errors: ' || CASE len(lint) WHEN 0 THEN '[]' ELSE '[''' || array_to_string(lint, ''', ''') || ''']' END || chr(10)
  || 'Security violations: ' || CASE len(viol) WHEN 0 THEN '[]' ELSE '[''' || array_to_string(viol, ''', ''') || ''']' END || chr(10) || chr(10)
  || 'Repair the code. Focus on fixing failing tests and security issues. Return ONLY the corrected code.' END AS prompt
FROM j""")
def txt25_tasks(spark, sf):
    docs, task, specs, attempts = _prompt_inputs(spark, sf)
    starters = docs.where("doc_id % 3 = 0").select(task.alias("task"), F.concat(F.lit("start "), F.col("doc_id").cast("string")).alias("starter"))
    return task_prompts(specs, starters, attempts)


@register("txt25_patch_prompts", oracle_cte("b_attempts_code", "b_code") + _LAST + f"""
SELECT task, format(E'Task: {{}}\\n\\n{{}}\\n\\n', name, spec) || CASE WHEN step IS NULL THEN
  replace(replace(split_part({q(TX.PATCH_FIRST)}, '{{spec}}' || chr(10) || chr(10), 2), '{{format}}', {q(TX.PATCH_FORMAT)}), '{{snapshot}}', b.code)
ELSE replace(replace(replace(replace(split_part({q(TX.PATCH_REPAIR)}, '{{spec}}' || chr(10) || chr(10), 2), '{{output}}', output),
  '{{lint}}', array_to_string(lint, chr(10))), '{{viol}}', array_to_string(viol, chr(10))), '{{snapshot}}', b.code) END AS prompt
FROM j JOIN b_code b USING (doc_id)""")
def txt25_patches(spark, sf):
    _, task, specs, attempts = _prompt_inputs(spark, sf)
    code = bridge(spark, sf, "b_code").select(task.alias("task"), F.col("code").alias("snapshot"))
    return patch_prompts(specs, code, attempts)


# ------------------------------------------------------------------ TXT-7, TXT-12 (rows only: Java-only regex)
@register("txt07_extract_code", oracle_cte("b_traj") + f"""
SELECT conv_id, CASE WHEN submission = '' THEN ''
         WHEN starts_with(submission, 'Here is the patch:') THEN {Q.strip(
             "replace(replace(submission, 'Here is the patch:' || chr(10) || '```diff' || chr(10), ''), '```' || chr(10) || 'Done.', '')")} || chr(10)
         ELSE {Q.strip('submission')} || chr(10) END AS code FROM b_traj""")
def txt07(spark, sf):
    t = bridge(spark, sf, "b_traj")
    return t.select("conv_id", TX.extract_code("submission").alias("code"))


@register("txt12_split_files", oracle_cte("b_traj") + f""",
resp AS (SELECT conv_id, '# pkg/a_' || CAST(conv_id AS VARCHAR) || '.py' || chr(10) || submission || chr(10)
                || '// pkg/b.py' || chr(10) || 'print(1)' || chr(10) || 'file: empty.py' AS t FROM b_traj),
l AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM resp),
h AS (SELECT *, regexp_extract(x, {q(TX._FILE_HDR)}, 1) AS h FROM l),
g AS (SELECT *, max(CASE WHEN h <> '' THEN i END) OVER (PARTITION BY conv_id ORDER BY i) AS n FROM h)
SELECT conv_id, CAST(n AS INT) AS n, max(h) AS path, string_agg(x, chr(10) ORDER BY i) FILTER (h = '') AS content
FROM g WHERE n IS NOT NULL GROUP BY conv_id, n HAVING count(*) > 1""")
def txt12(spark, sf):
    t = bridge(spark, sf, "b_traj").select(
        "conv_id", F.concat(F.lit("# pkg/a_"), F.col("conv_id").cast("string"), F.lit(".py\n"), F.col("submission"),
                            F.lit("\n// pkg/b.py\nprint(1)\nfile: empty.py")).alias("resp"))
    return t.select("conv_id", F.explode(TX.split_files("resp")).alias("f")).select("conv_id", "f.*")


# ------------------------------------------------------------------ FLT-*
@register("flt01_id_allow_list", oracle_cte("b_preds") + """
SELECT seq, instance_id FROM b_preds WHERE instance_id IN ('doc__1', 'doc__2', 'doc__30', 'doc__999')""")
def flt01(spark, sf):
    ids = [s.strip() for s in " doc__1, doc__2,doc__30 ,doc__999".split(",") if s.strip()]
    return bridge(spark, sf, "b_preds").where(F.col("instance_id").isin(ids)).select("seq", "instance_id")


@register("flt02_id_regex_filter", oracle_cte("b_preds") + """
SELECT seq, instance_id FROM b_preds WHERE regexp_matches(instance_id, 'doc__1\\d$') OR instance_id IN ('doc__2', 'doc__3')""")
def flt02(spark, sf):
    from gavel.operators.joins import selected
    keep = selected(F.col("instance_id"), "doc__2, doc__3", r"doc__1\d$")
    return bridge(spark, sf, "b_preds").where(keep).select("seq", "instance_id")


@register("flt05_row_limit", oracle_cte("b_preds") + """
SELECT seq, instance_id FROM b_preds ORDER BY instance_id LIMIT 25""")
def flt05(spark, sf):
    # The limit is the operator itself (the runner's --limit), over an explicit order.
    return bridge(spark, sf, "b_preds").orderBy("instance_id").limit(25).select("seq", "instance_id")


@register("flt06_py_files", oracle_cte("b_paths") + """
SELECT doc_id, path FROM b_paths WHERE ends_with(path, '.py')""")
def flt06(spark, sf):
    return bridge(spark, sf, "b_paths").where(F.col("path").endswith(".py")).select("doc_id", "path")


@register("flt07_accept", oracle_cte("b_eval") + """
SELECT task, coalesce(final_decision = 'OK' AND NOT coalesce(sad_flag, false) AND NOT coalesce(security_scan_failed, false)
             AND coalesce(cri, 0.0) >= 0.9, false) AS accepted FROM b_eval""")
def flt07(spark, sf):
    from gavel.operators.aggregates import accept_predicate
    return bridge(spark, sf, "b_eval").select("task", F.coalesce(accept_predicate(0.9), F.lit(False)).alias("accepted"))


@register("flt04_model_filter", oracle_cte("b_eval") + """
SELECT task, cri FROM b_eval WHERE model = 'model_1'""")
def flt04(spark, sf):
    return bridge(spark, sf, "b_eval").where(F.col("model") == "model_1").select("task", "cri")
