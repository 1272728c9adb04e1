"""More text operators: code extraction, log parsing, naming, prompts
(TXT-7, 12, 19..27), all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.text import LF, _c, lines_of, looks_like_unified_diff, py_strip, validate_unified_diff

# ------------------------------------------------------------------ TXT-7
_FENCE_ANY = r"(?sU)```([\w+-]*)\n(.*?)```"
_RAW_DIFF = r"(?m)(diff --git[\s\S]*?)(?=\n\n[A-Z]|\n\n```|\z)"
_MARKER = (r"(?is)(?:here(?:'s| is) the (?:complete |final )?(?:code|implementation|solution):?"
           r"" + K.PY_WS + r"*\n)(.*)")
_LANG_LINE = r"^[a-zA-Z0-9_+\-]+$"


def _nl(c: Column) -> Column:
    return F.when(c.endswith(LF), c).otherwise(F.concat(c, F.lit(LF)))


def extract_code(c) -> Column:
    """TXT-7: six tiers, first hit wins; result ends with a newline, an
    empty answer stays empty."""
    t = _c(c)
    langs = F.regexp_extract_all(t, F.lit(_FENCE_ANY), 1)
    bodies = F.transform(F.regexp_extract_all(t, F.lit(_FENCE_ANY), 2), lambda b: py_strip(b))
    pairs = F.arrays_zip(langs.alias("lang"), bodies.alias("body"))
    tier1 = F.filter(pairs, lambda p: F.lower(py_strip(p["lang"])).isin("diff", "patch")
                     & validate_unified_diff(p["body"]))
    tier2 = F.filter(pairs, lambda p: looks_like_unified_diff(p["body"]) & validate_unified_diff(p["body"]))
    raw = py_strip(F.regexp_extract(t, _RAW_DIFF, 1))
    tier3 = F.when(t.rlike(_RAW_DIFF) & validate_unified_diff(raw), raw)
    first = F.try_element_at(bodies, F.lit(1))
    first_lines = lines_of(first)
    drop_lang = (F.size(first_lines) > 0) & py_strip(F.try_element_at(first_lines, F.lit(1))).rlike(_LANG_LINE)
    tier4_body = F.when(drop_lang, py_strip(F.array_join(F.slice(first_lines, 2, 1 << 30), LF))).otherwise(first)
    tier4 = F.when((F.size(bodies) > 0) & (tier4_body != ""), tier4_body)
    marker = py_strip(F.regexp_extract(t, _MARKER, 1))
    tier5 = F.when(t.rlike(_MARKER) & (marker != ""), marker)
    tier6 = py_strip(t)
    pick = F.coalesce(F.try_element_at(tier1, F.lit(1))["body"], F.try_element_at(tier2, F.lit(1))["body"], tier3, tier4, tier5, tier6)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(_nl(pick))


# ------------------------------------------------------------------ TXT-12
_FILE_HDR = r"(?i)^(?:file:|#|//)" + K.PY_WS + r"*(" + K.PY_NONWS + r"+\.py)"


def split_files(c) -> Column:
    """TXT-12: 'file:'/'#'/'//' + '*.py' header lines start a new file; the
    following lines are its content. array<struct<n, path, content>>, files
    without content lines dropped."""
    lines = lines_of(c)
    idx = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"),
                                                  F.regexp_extract(x, _FILE_HDR, 1).alias("h")))
    heads = F.filter(idx, lambda s: s["h"] != "")

    def content(h):
        nxt = F.coalesce(F.array_min(F.transform(F.filter(heads, lambda g: g["i"] > h["i"]), lambda g: g["i"])),
                         F.size(lines))
        body = F.slice(lines, h["i"] + 2, F.greatest(nxt - h["i"] - 1, F.lit(0)))
        return F.struct(h["i"].alias("n"), h["h"].alias("path"), F.array_join(body, LF).alias("content"),
                        F.size(body).alias("_k"))

    files = F.transform(heads, content)
    return F.transform(F.filter(files, lambda f: f["_k"] > 0),
                       lambda f: F.struct(f["n"].alias("n"), f["path"].alias("path"), f["content"].alias("content")))


# ------------------------------------------------------------------ TXT-19
_PASSED = r"(\d+)" + K.PY_WS + r"+passed(?:," + K.PY_WS + r"+(\d+)" + K.PY_WS + r"+failed)?"
_FAILURES = r"(?d)FAILED.*failures=(\d+)"
_FAILED_FIRST = r"(\d+)" + K.PY_WS + r"+failed," + K.PY_WS + r"+(\d+)" + K.PY_WS + r"+passed"


def parse_test_output(c, sandbox: bool = False) -> Column:
    """TXT-19: (total_tests, tests_failed) from a test-runner log."""
    t = F.coalesce(_c(c), F.lit(""))

    def row(total, failed):
        return F.struct(total.cast("bigint").alias("total_tests"), failed.cast("bigint").alias("tests_failed"))

    p1 = F.regexp_extract(t, _PASSED, 1).cast("bigint")
    f1 = F.coalesce(F.nullif(F.regexp_extract(t, _PASSED, 2), F.lit("")).cast("bigint"), F.lit(0))
    f2 = F.regexp_extract(t, _FAILURES, 1).cast("bigint")
    out = F.when(t.rlike(_PASSED), row(p1 + f1, f1)).when(t.rlike(_FAILURES), row(f2, f2))
    if sandbox:
        return out.otherwise(row(F.lit(1), F.lit(1)))
    f3 = F.regexp_extract(t, _FAILED_FIRST, 1).cast("bigint")
    p3 = F.regexp_extract(t, _FAILED_FIRST, 2).cast("bigint")
    low = F.lower(t)
    return (out.when(t.rlike(_FAILED_FIRST), row(p3 + f3, f3))
            .when(low.contains("passed") & ~low.contains("fail"), row(F.lit(1), F.lit(0)))
            .otherwise(row(F.lit(1), F.lit(1))))


# ------------------------------------------------------------------ TXT-20
def classify_eval_log(c) -> Column:
    """TXT-20: struct(resolved, resolved_status) or null when undecided."""
    t = F.coalesce(_c(c), F.lit(""))
    failed = F.lit(False)
    for m in K.PATCH_APPLY_MARKERS:
        failed = failed | t.contains(m)
    flag = F.regexp_extract(t, r"resolved:" + K.PY_WS + r"*(True|False)", 1)

    def row(r, s):
        return F.struct(r.alias("resolved"), s.alias("resolved_status"))

    return (F.when(failed, row(F.lit(False), F.lit("PATCH_APPLY_FAILED")))
            .when(flag != "", row(flag == "True", F.when(flag == "True", F.lit("RESOLVED"))
                                  .otherwise(F.lit("UNRESOLVED")))))


# ------------------------------------------------------------------ TXT-21
def linter_lines(exit_code, output) -> Column:
    """TXT-21: non-blank output lines; a clean exit with blank output -> []."""
    out = F.coalesce(_c(output), F.lit(""))
    lines = F.filter(lines_of(out), lambda x: py_strip(x) != "")
    return F.when((_c(exit_code) == 0) & (py_strip(out) == ""), F.array().cast("array<string>")).otherwise(lines)


# ------------------------------------------------------------ TXT-22..24, 27
def safe_name(c) -> Column:
    """TXT-22: runs outside [A-Za-z0-9_.-] become '_' (after stripping)."""
    return F.regexp_replace(py_strip(_c(c)), r"[^A-Za-z0-9_.-]+", "_")


def run_index(c) -> Column:
    """TXT-23 building block: the N of '_runN' in a name, or null."""
    return F.nullif(F.regexp_extract(_c(c), r"_run(\d+)", 1), F.lit("")).cast("bigint")


def run_label(model, config, rep, instance) -> Column:
    """TXT-24: model/config/rep/instance -> a directory label."""
    return F.concat(F.replace(_c(model), F.lit("/"), F.lit("_")), F.lit("_"),
                    F.replace(_c(config), F.lit("-"), F.lit("no")), F.lit("_r"), _c(rep).cast("string"),
                    F.lit("_"), F.replace(_c(instance), F.lit("/"), F.lit("_")))


def state_key(model, config, instance, rep) -> Column:
    """TXT-24: 'model|config|instance|rN'."""
    return F.concat_ws("|", _c(model), _c(config), _c(instance), F.concat(F.lit("r"), _c(rep).cast("string")))


def tail(c, n: int) -> Column:
    """TXT-27: keep the last n characters of a longer prompt."""
    t = _c(c)
    return F.when(F.length(t) > n, F.substring(t, -n, n)).otherwise(t)


# ------------------------------------------------------------------ TXT-25
# fixed values: prompt templates of the repair loop
FIRST_ATTEMPT = ("Task: {name}\nLanguage: {language}\n\nSpecification:\n{spec}\n\n"
                 "Starter code (you MAY reuse or refactor):\n```{language}\n{starter}\n```\n\n"
                 "Write a complete, working solution in one file. Return ONLY the final code.")
REPAIR = ("Task: {name}\nLanguage: {language}\n\nSpecification:\n{spec}\n\n"
          "You wrote the following code which FAILED tests or checks:\n```{language}\n{previous}\n```\n\n"
          "Test / linter / security output:\n{output}\nLinter errors: {lint}\nSecurity violations: {viol}\n\n"
          "Repair the code. Focus on fixing failing tests and security issues. Return ONLY the corrected code.")


PATCH_FORMAT = (
    "diff --git a/path/to/file.py b/path/to/file.py\n--- a/path/to/file.py\n+++ b/path/to/file.py\n"
    "@@ -10,7 +10,7 @@ def function_name():\n context line\n-old line\n+new line\n context line\n")
PATCH_FIRST = (
    "Task: {name}\n\n{spec}\n\nYou are given a real Python repository with failing tests.\n"
    "Propose a patch that fixes the bug without introducing new security issues.\n\n"
    "Relevant code:\n```python\n{snapshot}\n```\n\n"
    "CRITICAL: Return ONLY a valid unified diff patch in this EXACT format:\n\n{format}\n"
    "Rules:\n1. Start with 'diff --git a/FILE b/FILE' for each file you modify.\n"
    "2. Include both '--- a/FILE' and '+++ b/FILE' headers.\n"
    "3. Each hunk MUST have complete @@ headers like '@@ -X,Y +A,B @@'.\n"
    "4. Do NOT include explanations, markdown fences, or comments outside the diff.\n"
    "5. Output ONLY the raw patch text.\n")
PATCH_REPAIR = (
    "Task: {name}\n\n{spec}\n\nYour previous patch failed to apply or did not solve the problem.\n"
    "Here is the latest test, linter, and security output:\n\n{output}\n\nLinter errors:\n{lint}\n\n"
    "Security violations:\n{viol}\n\nRelevant code snapshot:\n```python\n{snapshot}\n```\n\n"
    "CRITICAL: Return ONLY a valid unified diff patch.\nUse the EXACT format from the first attempt.\n"
    "Start with 'diff --git', include full headers, and complete '@@ -X,Y +A,B @@' lines.\n"
    "NO explanations, NO markdown fences, ONLY the raw patch text.\n")


def _template(tpl: str, cols: dict) -> Column:
    parts, rest = [], tpl
    while "{" in rest:
        a = rest.index("{")
        b = rest.index("}", a)
        if a:
            parts.append(F.lit(rest[:a]))
        parts.append(F.coalesce(cols[rest[a + 1:b]], F.lit("")))
        rest = rest[b + 1:]
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def py_list_repr(arr) -> Column:
    """Python repr of a list of plain strings: ['a', 'b']."""
    a = _c(arr)
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                    F.lit("]"))


def build_prompt(name, language, spec, starter, previous=None, output=None, lint=None, viol=None) -> Column:
    """TXT-25: first-attempt prompt, or the repair prompt when a previous
    attempt exists."""
    first = _template(FIRST_ATTEMPT, {"name": _c(name), "language": _c(language), "spec": _c(spec),
                                      "starter": _c(starter)})
    if previous is None:
        return first
    repair = _template(REPAIR, {"name": _c(name), "language": _c(language), "spec": _c(spec),
                                "previous": _c(previous), "output": _c(output),
                                "lint": py_list_repr(lint), "viol": py_list_repr(viol)})
    return F.when(_c(previous).isNull(), first).otherwise(repair)


def build_patch_prompt(name, spec, snapshot, repair, output, lint, viol) -> Column:
    """TXT-25, repository tasks: the first prompt, or with ``repair`` the one that
    states the last checks; both carry the code snapshot."""
    base = {"name": _c(name), "spec": _c(spec), "snapshot": _c(snapshot)}
    first = _template(PATCH_FIRST, base | {"format": F.lit(PATCH_FORMAT)})
    lines = {"lint": F.array_join(_c(lint), "\n"), "viol": F.array_join(_c(viol), "\n")}
    return F.when(_c(repair), _template(PATCH_REPAIR, base | {"output": _c(output)} | lines)).otherwise(first)
