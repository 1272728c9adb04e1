"""Text and diff expressions (Column -> Column), all JVM-side.

Patches are split on LF only; normalisation turns CR and CRLF into LF first,
so the only lines that differ from Python's ``splitlines`` are ones that
contain VT/FF/FS/GS/RS/NEL/LS/PS, which are kept inside the line here.
Patterns use ``PY_WS`` where Python's Unicode ``\\s``/``strip`` semantics are
needed, and ``\\z`` for a strict end of input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.constants import PY_NONWS, PY_WS, PY_WS_LITERAL, SNIPPET_KEEP, SNIPPET_MAX

LF = "\n"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- whitespace
def py_lstrip(c) -> Column:
    """Python ``str.lstrip()``: a character-set trim, no regex."""
    return F.ltrim(_c(c), F.lit(PY_WS_LITERAL))


def py_rstrip(c) -> Column:
    return F.rtrim(_c(c), F.lit(PY_WS_LITERAL))


def py_strip(c) -> Column:
    return F.trim(_c(c), F.lit(PY_WS_LITERAL))


def strip_newlines(c) -> Column:
    """Python ``s.strip('\\n')`` (a character trim, no regex)."""
    return F.trim(_c(c), F.lit(LF))


def lines_of(c) -> Column:
    return F.split(_c(c), LF, -1)


_MEMO: dict = {}


def memo_column(key, build) -> Column:
    """Reuse an expensive-to-build Column per SparkContext. Unresolved
    expressions are immutable and resolve against each plan separately, so
    building the large higher-order-function trees once saves thousands of
    driver round trips per query."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    k = (id(sc), sc.applicationId if sc is not None else None, key)
    col = _MEMO.get(k)
    if col is None:
        col = build()
        _MEMO[k] = col
    return col


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda):
    ``transform(array(value), v -> body(v))[0]``. Keeps expression trees
    linear when the optimizer inlines projections into later operators."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ------------------------------------------------------------ TXT-1 / TXT-2
_FENCE = r"(?s)```(?:diff|patch)?" + PY_WS + r"*\n(.*?)\n```"
_OUTER_OPEN = "^" + PY_WS + r"*```(?:diff|patch)?" + PY_WS + r"*\n?"
_OUTER_CLOSE = r"(?s)\A(.*?)\n?" + PY_WS + r"*```" + PY_WS + r"*(?=\n|\z)"


_ZERO_INDENT = r"(?m)(?d)^" + PY_NONWS


def safe_dedent(c) -> Column:
    """TXT-2: remove the common indent of non-blank lines; a whitespace-only
    line that would vanish becomes a single space. A non-blank line at
    column 0 makes the margin 0 (identity) without splitting lines."""
    def body(text):
        def with_lines(lines):
            indents = F.transform(F.filter(lines, lambda x: py_lstrip(x) != ""),
                                  lambda x: F.length(x) - F.length(py_lstrip(x)))

            def with_margin(margin):
                cut = F.transform(lines, lambda x: F.when(x == "", x)
                                  .when(F.length(x) <= margin, F.lit(" "))
                                  .otherwise(x.substr(margin + 1, F.length(x))))
                return F.when(margin.isNotNull() & (margin > 0), F.array_join(cut, LF)).otherwise(text)
            return let(F.array_min(indents), with_margin)
        return F.when(text.rlike(_ZERO_INDENT), text).otherwise(let(lines_of(text), with_lines))
    return let(_c(c), body)


def normalize_patch(c) -> Column:
    """TXT-1: canonical patch text (see module doc for the LF-only rule).

    One linear-size expression: every intermediate is bound once with
    ``let``. Exact fast paths keep typical patches off the per-line path:
    text that starts with a git header has its start at line 1; text
    without a fence marker needs no fence-line filter; text with a
    non-blank line at column 0 has a dedent margin of 0.
    """
    def with_cand(cand):
        maybe_header = cand.contains("diff --git ") | cand.contains("--- ")

        def with_lines(lines):
            start = F.when(cand.startswith("diff --git "), F.lit(1)).when(
                maybe_header, _start(F.transform(lines, lambda x: py_lstrip(x))))

            def with_start(st):
                tail = F.slice(lines, F.coalesce(st, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
                block = F.filter(tail, lambda x: ~py_lstrip(x).startswith("```"))
                body = (F.when(st.isNull(), cand)
                        .when(cand.contains("```"), F.array_join(block, LF))
                        .when(st == 1, cand)
                        .otherwise(F.array_join(tail, LF)))
                return F.concat(strip_newlines(safe_dedent(body)), F.lit(LF))
            return let(start, with_start)
        return let(lines_of(cand), with_lines)
    return let(_raw(_c(c)), lambda raw: let(_candidate(raw), with_cand))


def _raw(c: Column) -> Column:
    raw = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit(LF)), F.lit("\r"), F.lit(LF))
    return F.when(raw.startswith("\ufeff"), F.regexp_replace(raw, "^\ufeff+", "")).otherwise(raw)


def _candidate(raw: Column) -> Column:
    def with_bare(bare):
        unwrapped = F.regexp_replace(F.regexp_replace(bare, _OUTER_OPEN, ""), _OUTER_CLOSE, "$1")
        fenced = raw.contains("```")  # cheap guard before any fence regex
        bare2 = F.when(fenced & bare.rlike("^" + PY_WS + "*```"), unwrapped).otherwise(bare)
        return F.when(fenced & raw.rlike(_FENCE), F.regexp_extract(raw, _FENCE, 1)).otherwise(bare2)
    return let(strip_newlines(raw), with_bare)


def _start(left: Column) -> Column:
    """1-based index of the first diff header line (git, else '--- ' with a
    later '+++ '), or null."""
    def body(lf):
        git_pos = F.array_position(F.transform(lf, lambda x: x.startswith("diff --git ")), True)
        last_plus = F.array_max(F.transform(lf, lambda x, i: F.when(x.startswith("+++ "), i).otherwise(-1)))

        def with_last(lp):
            first_minus = F.array_min(F.transform(lf, lambda x, i: F.when(x.startswith("--- ") & (i < lp), i)))
            return F.when(git_pos > 0, git_pos).otherwise(first_minus + 1)
        return let(last_plus, with_last)
    return let(left, body)


def with_normalized_patch(df, src: str, out: str = "patch"):
    """TXT-1 as a column of ``df``."""
    return df.withColumn(out, memo_column(("normalize_patch", src), lambda: normalize_patch(F.col(src))))


def with_safe_dedent(df, src: str, out: str):
    """TXT-2 as a column of ``df``."""
    return df.withColumn(out, memo_column(("safe_dedent", src), lambda: safe_dedent(F.col(src))))


# --------------------------------------------------------------- TXT-3..6, 8
def looks_like_diff(c) -> Column:
    """TXT-3 (loose): a git header, or a '--- ' line and a '+++ ' line."""
    t = _c(c)
    return (t.contains("diff --git")
            | (t.rlike(r"(?m)(?d)^--- ") & t.rlike(r"(?m)(?d)^\+\+\+ ")))


_HUNK_FULL = r"(?m)(?d)^@@ -\d+,\d+ \+\d+,\d+ @@"


def looks_like_unified_diff(c) -> Column:
    """TXT-4: git header, or a full hunk header together with file markers."""
    t = _c(c)
    markers = t.rlike(r"(?m)(?d)^--- ") & t.rlike(r"(?m)(?d)^\+\+\+ ")
    return t.rlike(r"(?m)(?d)^diff --git") | (t.rlike(_HUNK_FULL) & markers)


def looks_like_unified_diff_swe(c) -> Column:
    """TXT-5: git header, any '@@' line, or both file markers."""
    t = _c(c)
    return (t.rlike(r"(?m)(?d)^diff --git") | t.rlike(r"(?m)(?d)^@@")
            | (t.rlike(r"(?m)(?d)^--- ") & t.rlike(r"(?m)(?d)^\+\+\+ ")))


def validate_unified_diff(c) -> Column:
    """TXT-6: a full hunk header AND (git header OR both markers)."""
    lines = lines_of(_c(c))
    has_header = F.exists(lines, lambda x: x.startswith("diff --git"))
    has_files = F.exists(lines, lambda x: x.startswith("---")) & F.exists(lines, lambda x: x.startswith("+++"))
    has_hunk = F.exists(lines, lambda x: x.rlike(r"^@@ -\d+,\d+ \+\d+,\d+ @@"))
    return has_hunk & (has_header | has_files)


def is_no_patch(c) -> Column:
    """TXT-8: blank or the NO_PATCH sentinel (any case)."""
    t = py_strip(F.coalesce(_c(c), F.lit("")))
    return (t == "") | (F.upper(t) == "NO_PATCH")


# ------------------------------------------------------------------ TXT-9
def added_lines(c) -> Column:
    """TXT-9: array<struct<pos, path, line>> of the '+' lines inside hunks.

    The lines are cut into blocks at the 'diff --git ' lines (and one block before the
    first), so a line only meets the headers of its own block: it is inside
    a hunk when the block's first '@@ ' line precedes it; its path is the block's
    last '+++ ' line before it. No sequential fold, no shuffle; cost O(lines)
    for any number of files with a header each. Every intermediate is bound
    once (``let``), so the expression stays linear in size.
    """
    idx0 = F.transform(lines_of(c), lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def with_idx(idx):
        heads = F.transform(F.filter(idx, lambda s: s["x"].startswith("diff --git ")), lambda s: s["i"])
        cuts = F.concat(F.array(F.lit(0)), heads, F.array(F.size(idx)))
        return let(cuts, lambda cut: F.flatten(F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda start, k: let(
            F.slice(idx, start + 1, F.get(cut, k + 1) - start), _added_in_block))))
    return let(idx0, with_idx)


def _added_in_block(block: Column) -> Column:
    """The added lines of one file's block, as (pos, path, line)."""
    hunk = F.array_min(F.transform(F.filter(block, lambda s: s["x"].startswith("@@ ")), lambda s: s["i"]))
    plus = F.transform(F.filter(block, lambda s: s["x"].startswith("+++ ")),
                       lambda s: F.struct(s["i"].alias("i"), plus_path(s["x"]).alias("p")))
    start = F.coalesce(hunk, F.lit(1 << 30))
    parts = F.struct(start.alias("k"), plus.alias("p"))
    return let(parts, lambda h: F.transform(
        F.filter(block, lambda s: s["x"].startswith("+") & ~s["x"].startswith("+++ ") & (s["i"] > h["k"])),
        lambda s: F.struct(s["i"].alias("pos"), F.array_max(F.filter(h["p"], lambda q: q["i"] < s["i"]))["p"].alias("path"),
                           F.substring(s["x"], 2, 1 << 30).alias("line"))))


def with_added_lines(df, src: str, out: str = "added"):
    """TXT-9 as a column of ``df`` (see ``added_lines``)."""
    return df.withColumn(out, memo_column(("added_lines", src), lambda: added_lines(F.col(src))))


def explode_added_lines(df, src: str, key: str = "seq"):
    """TXT-9 as rows (UDTF shape): one row per added line with its position,
    path and text, exploded from the in-row result: no exchange, and rows that
    share a key stay apart."""
    return with_added_lines(df, src, "_added").select(key, F.explode("_added").alias("_l")).select(
        key, F.col("_l.pos").cast("int").alias("pos"), "_l.path", "_l.line")


def plus_path(line) -> Column:
    """Path of a '+++ ' header: second whitespace token without 'b/'."""
    tok = F.regexp_extract(_c(line), r"^\+\+\+" + PY_WS + r"+(" + PY_NONWS + r"+)", 1)
    return F.regexp_replace(tok, "^b/", "")


# ----------------------------------------------------------- TXT-10, TXT-11
def files_in_patch(c) -> Column:
    """TXT-10: distinct sorted paths named by '+++'/'---' lines (text after
    the first 'a/' or 'b/')."""
    lines = F.filter(lines_of(c), lambda x: x.startswith("+++") | x.startswith("---"))
    paths = F.transform(lines, lambda x: F.regexp_extract(x, r"(?d)[ab]/(.+)", 1))
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: p != "")))


def changed_file_count(c) -> Column:
    """TXT-11: number of lines starting with 'diff --git '."""
    return F.size(F.filter(lines_of(c), lambda x: x.startswith("diff --git ")))


# ------------------------------------------------------------ TXT-13..18
def patch_bytes(c) -> Column:
    return F.octet_length(_c(c)).cast("bigint")


def patch_sha256(c) -> Column:
    return F.sha2(_c(c), 256)


def is_test_path(c) -> Column:
    """TXT-14."""
    p = F.lower(F.regexp_replace(_c(c), r"\\", "/"))
    hit = (p.contains("/tests/") | p.startswith("tests/") | p.contains("/test_")
           | p.endswith("_test.py") | p.startswith("test_"))
    return F.coalesce(hit & (p != ""), F.lit(False))


def secret_severity(path, value) -> Column:
    """TXT-15: 'info' on test paths or dummy-looking values, else 'high'."""
    v = F.lower(py_strip(F.coalesce(_c(value), F.lit(""))))
    dummy = v.contains("test") | v.contains("dummy") | v.contains("example") | v.contains("sample")
    return F.when(is_test_path(path) | dummy, F.lit("info")).otherwise(F.lit("high"))


def tag_violation(c, severity="high") -> Column:
    """TXT-16: keep bracketed entries, else prefix '[sev] '."""
    e = F.coalesce(_c(c), F.lit(""))
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(py_lstrip(e).startswith("["), e).otherwise(F.concat(F.lit("["), sev, F.lit("] "), e))


def violation_severity(c) -> Column:
    """TXT-16: 'info' only for an '[info]' prefix, otherwise 'high'."""
    return F.when(py_lstrip(F.coalesce(_c(c), F.lit(""))).startswith("[info]"), F.lit("info")).otherwise(F.lit("high"))


def cap_snippet(c) -> Column:
    """TXT-17."""
    t = _c(c)
    return F.when(F.length(t) > SNIPPET_MAX, F.concat(F.substring(t, 1, SNIPPET_KEEP), F.lit("..."))).otherwise(t)


def infra_timeout_docker(c) -> Column:
    """TXT-18a: mentions docker and 'timed out after N seconds'."""
    from gavel.constants import TIMEOUT_RE
    t = F.coalesce(_c(c), F.lit(""))
    return (t != "") & F.lower(t).contains("docker") & t.rlike(TIMEOUT_RE)


def infra_timeout_phrase(c) -> Column:
    """TXT-18b: the timeout phrase alone."""
    from gavel.constants import TIMEOUT_RE
    t = F.coalesce(_c(c), F.lit(""))
    return (t != "") & t.rlike(TIMEOUT_RE)


def infra_text_loose(c) -> Column:
    """TXT-18c: loose substring pair used by the skip rule."""
    t = F.lower(py_strip(F.coalesce(_c(c), F.lit(""))))
    return t.contains("timed out after") & t.contains("seconds")
