"""Security-scan expressions (Column -> Column), JVM-side regex work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.text import _c, added_lines, cap_snippet, py_lstrip, py_strip, secret_severity


def has_python_tokens(c) -> Column:
    """FLT-9: any of 'def ', 'class ', 'import ', 'from ', 'async '."""
    t = F.coalesce(_c(c), F.lit(""))
    hit = F.lit(False)
    for tok in K.PY_LIKE_TOKENS:
        hit = hit | t.contains(tok)
    return hit


def code_lines(added) -> Column:
    """FLT-8: added lines that are neither empty nor comments."""
    return F.filter(added, lambda a: (a["line"] != "") & ~py_lstrip(a["line"]).startswith("#"))


def secret_findings(added) -> Column:
    """SEC-13 regex layer over added lines (see secret_findings_from_code)."""
    return secret_findings_from_code(code_lines(added))


# Every spelling the case-insensitive secret pattern accepts contains one of
# these lower-case fragments ('ſ' folds to 's' and 'K' to 'k' under Unicode
# case folding, so the fragments avoid those letters): an exact cheap guard.
_SECRET_GUARDS = ("ecret", "oken", "word", "ey")


def secret_guard(line) -> Column:
    low = F.lower(_c(line))
    hit = F.lit(False)
    for g in _SECRET_GUARDS:
        hit = hit | low.contains(g)
    return hit


def secret_findings_from_code(code) -> Column:
    """SEC-13 regex layer: tagged SECRETS_POSSIBLE_HARDCODED labels, sorted
    and distinct, one per (line, match). A match never includes the line's
    leading or trailing blanks, so the pattern runs on the raw line behind a
    substring guard and only matching lines are stripped for the snippet."""
    from gavel.functions.text import let

    def per_line(a):
        values = F.when(secret_guard(a["line"]), F.regexp_extract_all(a["line"], F.lit(K.SECRET_RE), 2)) \
            .otherwise(F.array().cast("array<string>"))

        def tag(vals):
            def with_norm(norm):
                snippet = cap_snippet(norm)
                label = F.when(F.coalesce(a["path"], F.lit("")) != "",
                               F.concat(F.lit(K.SECRET_LABEL + "@"), a["path"], F.lit(": "), snippet)
                               ).otherwise(F.concat(F.lit(K.SECRET_LABEL + ": "), snippet))
                return F.transform(vals, lambda v: F.concat(F.lit("["), secret_severity(a["path"], v), F.lit("] "),
                                                            label))
            return F.when(F.size(vals) == 0, vals).otherwise(let(py_strip(a["line"]), with_norm))
        return let(values, tag)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(code, per_line))))


def diff_scan(patch) -> Column:
    """SEC-13 without the parse check as ONE struct column: light (sorted
    tagged findings), haspy, blank, ncode and parse_in (the added code to
    parse, null wherever the outcome does not depend on the parse). Each
    intermediate is bound once, so the expression stays linear in size."""
    from gavel.functions.text import added_lines, let

    def with_src(src):
        def with_code(code):
            snip = F.array_join(F.transform(code, lambda a: a["line"]), "\n")
            light = secret_findings_from_code(code)
            haspy = has_python_tokens(src)

            def finish(v):
                blank = py_strip(v["snip"]) == ""
                parse_in = F.when((F.size(v["light"]) == 0) & v["haspy"] & ~blank, v["snip"])
                return F.struct(v["light"].alias("light"), v["haspy"].alias("haspy"), blank.alias("blank"),
                                v["ncode"].alias("ncode"), parse_in.alias("parse_in"))
            return let(F.struct(snip.alias("snip"), light.alias("light"), haspy.alias("haspy"),
                                F.size(code).alias("ncode")), finish)
        return let(code_lines(added_lines(src)), with_code)
    return let(_c(patch), with_src)


def with_diff_scan(df, patch: str, need: Column | None = None, prefix: str = "_ds"):
    """SEC-13 staged onto ``df``: adds ``{prefix}_light``, ``_haspy``,
    ``_blank``, ``_ncode`` and ``_parse_in``. Rows with ``need`` false are
    skipped (null results)."""
    from gavel.functions.text import memo_column
    src = F.col(patch) if need is None else F.when(need, F.col(patch))
    df = df.withColumn(f"{prefix}_src", src)
    df = df.withColumn(f"{prefix}_scan", memo_column(("diff_scan", f"{prefix}_src"),
                                                     lambda: diff_scan(F.col(f"{prefix}_src"))))
    for f in ("light", "haspy", "blank", "ncode", "parse_in"):
        df = df.withColumn(f"{prefix}_{f}", F.col(f"{prefix}_scan.{f}"))
    return df.drop(f"{prefix}_scan", f"{prefix}_src")


def diff_scan_failed(patch_is_null: Column, light: Column, has_python: Column, snippet_blank: Column,
                     parse_ok: Column) -> Column:
    """SEC-13 coverage rule: any regex hit means covered; otherwise failed
    unless the added Python parses cleanly."""
    return (F.when(patch_is_null, F.lit(True))
            .when(F.size(light) > 0, F.lit(False))
            .when(~has_python | snippet_blank, F.lit(True))
            .otherwise(~F.coalesce(parse_ok, F.lit(False))))


# ------------------------------------------------------------- SEC-1..9
def rule_findings(code, rules) -> Column:
    """SEC-1..9: regex heuristics gated by the task's rule families, then
    sorted and distinct. ``rules`` is an array<string> column or a list."""
    t = F.coalesce(_c(code), F.lit(""))
    r = F.array(*[F.lit(x) for x in rules]) if isinstance(rules, (list, tuple)) else _c(rules)

    def on(family, cond, name):
        return F.when(F.array_contains(r, family) & cond, F.lit(name))

    writes = F.regexp_count(t, F.lit(K.RULE_WRITES))
    found = F.array(
        on("SQLI", t.rlike(K.RULE_SQLI_TEMPLATE), "SQLI_TEMPLATE_INTERPOLATION"),
        on("SQLI", t.rlike(K.RULE_SQLI_CONCAT), "SQLI_STRING_CONCAT"),
        on("SQLI", t.rlike(K.RULE_SQLI_FSTRING), "SQLI_FSTRING"),
        on("SQLI", t.rlike(K.RULE_SQL_VERB) & ~t.rlike(K.RULE_SQL_PARAMS), "SQLI_NO_PARAMETERIZATION"),
        on("MISSING_AUTH", t.rlike(K.RULE_ENDPOINT) & t.rlike(K.RULE_MENTIONS_USER) & ~t.rlike(K.RULE_HAS_AUTH),
           "MISSING_AUTH_CHECK"),
        on("NO_TRANSACTION", (writes >= 2) & ~t.rlike(K.RULE_TX), "NO_TRANSACTION_FOR_MULTI_WRITE"),
        on("XSS", t.rlike(K.RULE_XSS), "POTENTIAL_XSS"),
        on("SECRETS", t.rlike(K.RULE_SECRETS), "HARDCODED_SECRETS"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def merge_findings(*arrays) -> Column:
    """SEC-9 / SET-3: union of finding arrays, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>"))
                                                            for a in arrays]))))


# --------------------------------------------------------------- SEC-11
def substring_findings(code, active=None) -> Column:
    """SEC-11: substring scanner restricted to the active rule ids."""
    t = F.coalesce(_c(code), F.lit(""))
    low = F.lower(t)
    act = set(active) if active is not None else set(K.SUBSTRING_DEFAULT_RULES)
    out = []
    for rule, needles in K.SUBSTRING_RULES:
        if rule in act:
            cond = F.lit(False)
            for n in needles:
                cond = cond | t.contains(n)
            out.append(F.when(cond, F.lit(rule)))
    if "SQLI_FSTRING" in act:
        sql = F.lit(False)
        for w in K.SUBSTRING_SQL_WORDS:
            sql = sql | low.contains(w)
        fq = F.lit(False)
        for q in K.SUBSTRING_FQUOTES:
            fq = fq | t.contains(q)
        out.append(F.when(sql & fq, F.lit("SQLI_FSTRING")))
    if not out:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*out))
