"""DuckDB expression builders used by the oracle SQL (independent of the
Spark Column code: the oracle explodes lines and uses window functions
where Spark folds arrays inside the row)."""

from __future__ import annotations

from gavel import constants as K

WS = K.PY_WS
LFQ = "chr(10)"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def strip_nl(x: str) -> str:
    return f"regexp_replace({x}, '^\\n+|\\n+\\z', '', 'g')"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Java pattern -> RE2: drop the UNIX_LINES flag (RE2 is LF-only already)."""
    return pattern.replace("(?id)", "(?i)").replace("(?md)", "(?m)").replace("(?m)(?d)", "(?m)").replace("(?d)", "")


FENCE = r"(?s)```(?:diff|patch)?" + WS + r"*\n(.*?)\n```"
OUTER_OPEN = "^" + WS + r"*```(?:diff|patch)?" + WS + r"*\n?"
OUTER_CLOSE = r"(?s)\A(.*?)\n?" + WS + r"*```" + WS + r"*(\n|\z)"


def normalize_ctes(src: str, raw_col: str, keep: str, prefix: str = "nz") -> tuple[str, str]:
    """CTE chain normalising ``raw_col`` of ``src`` into column ``patch``.
    Returns (ctes_text, final_cte_name). ``keep`` = other columns to carry."""
    k = (keep + ", ") if keep else ""
    c0 = (f"{prefix}0 AS (SELECT {k}regexp_replace(replace(replace(coalesce({raw_col}, ''), chr(13) || chr(10), chr(10)),"
          f" chr(13), chr(10)), '^\\x{{FEFF}}+', '') AS raw FROM {src})")
    c1 = (f"{prefix}1 AS (SELECT {k}raw, regexp_matches(raw, {q(FENCE)}) AS has_fence,"
          f" regexp_extract(raw, {q(FENCE)}, 1) AS fenced, {strip_nl('raw')} AS bare FROM {prefix}0)")
    c2 = (f"{prefix}2 AS (SELECT {k}CASE WHEN has_fence THEN fenced"
          f" WHEN regexp_matches(bare, {q('^' + WS + '*```')}) THEN regexp_replace(regexp_replace(bare, {q(OUTER_OPEN)}, ''),"
          f" {q(OUTER_CLOSE)}, '\\1\\2') ELSE bare END AS cand FROM {prefix}1)")
    c3 = (f"{prefix}3 AS (SELECT {k}cand, string_split(cand, chr(10)) AS lines,"
          f" list_transform(string_split(cand, chr(10)), lambda x: {lstrip('x')}) AS lft FROM {prefix}2)")
    c4 = (f"{prefix}4 AS (SELECT {k}cand, lines, lft,"
          f" list_position(list_transform(lft, lambda x: starts_with(x, 'diff --git ')), true) AS git_pos,"
          f" list_max(list_transform(lft, lambda x, i: CASE WHEN starts_with(x, '+++ ') THEN i ELSE -1 END)) AS last_plus"
          f" FROM {prefix}3)")
    c5 = (f"{prefix}5 AS (SELECT {k}cand, lines, coalesce(git_pos, list_min(list_filter(list_transform(lft,"
          f" lambda x, i: CASE WHEN starts_with(x, '--- ') AND i < last_plus THEN i ELSE NULL END), lambda y: y IS NOT NULL)))"
          f" AS start FROM {prefix}4)")
    c6 = (f"{prefix}6 AS (SELECT {k}CASE WHEN start IS NULL THEN cand ELSE array_to_string(list_filter("
          f"list_slice(lines, start, len(lines)), lambda x: NOT starts_with({lstrip('x')}, '```')), chr(10)) END AS body"
          f" FROM {prefix}5)")
    c7 = (f"{prefix}7 AS (SELECT {k}body, string_split(body, chr(10)) AS bl,"
          f" list_min(list_transform(list_filter(string_split(body, chr(10)), lambda x: {lstrip('x')} <> ''),"
          f" lambda x: length(x) - length({lstrip('x')}))) AS margin FROM {prefix}6)")
    c8 = (f"{prefix}8 AS (SELECT {k}CASE WHEN margin > 0 THEN array_to_string(list_transform(bl, lambda x:"
          f" CASE WHEN x = '' THEN x WHEN length(x) <= margin THEN ' ' ELSE substring(x, margin + 1) END), chr(10))"
          f" ELSE body END AS ded FROM {prefix}7)")
    c9 = f"{prefix}9 AS (SELECT {k}{strip_nl('ded')} || chr(10) AS patch FROM {prefix}8)"
    return ",\n".join([c0, c1, c2, c3, c4, c5, c6, c7, c8, c9]), f"{prefix}9"


def is_test_path(p: str) -> str:
    x = f"lower(replace({p}, '\\', '/'))"
    return (f"coalesce(({x} <> '' AND (contains({x}, '/tests/') OR starts_with({x}, 'tests/') OR contains({x}, '/test_')"
            f" OR ends_with({x}, '_test.py') OR starts_with({x}, 'test_'))), false)")


def severity_of(v: str) -> str:
    return f"CASE WHEN starts_with({lstrip('coalesce(' + v + ', ' + q('') + ')')}, '[info]') THEN 'info' ELSE 'high' END"


def tag(v: str) -> str:
    e = f"coalesce({v}, '')"
    return f"CASE WHEN starts_with({lstrip(e)}, '[') THEN {e} ELSE '[high] ' || {e} END"


def clip01(x: str) -> str:
    return f"CASE WHEN ({x}) < 0.0 THEN 0.0::DOUBLE WHEN ({x}) > 1.0 THEN 1.0::DOUBLE ELSE ({x}) END"


def cri_v2(tp: str, tt: str, viol: str, failed: str, infra: str = "0.0::DOUBLE") -> str:
    v = f"coalesce({viol}, CAST([] AS VARCHAR[]))"
    high = f"len(list_filter({v}, lambda z: {severity_of('z')} = 'high'))"
    info = f"(len({v}) - {high})"
    rate = f"CASE WHEN {tt} > 0 THEN {clip01(f'CAST({tp} AS DOUBLE) / CAST({tt} AS DOUBLE)')} ELSE 0.0::DOUBLE END"
    pen = (f"(0.4::DOUBLE * {high} + 0.05::DOUBLE * {info} + CASE WHEN coalesce({failed}, false) AND len({v}) = 0"
           f" THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)")
    return clip01(f"{rate} * (1.0::DOUBLE - {infra}) - {pen}")


def status_norm(s: str) -> str:
    return f"lower({strip('coalesce(' + s + ', ' + q('') + ')')})"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


def dedent_ctes(src: str, col: str, keep: str, prefix: str = "dd") -> tuple[str, str]:
    """CTE chain: safe dedent of ``col`` into column ``ded``."""
    k = (keep + ", ") if keep else ""
    c0 = (f"{prefix}0 AS (SELECT {k}{col} AS body, string_split({col}, chr(10)) AS bl,"
          f" list_min(list_transform(list_filter(string_split({col}, chr(10)), lambda x: {lstrip('x')} <> ''),"
          f" lambda x: length(x) - length({lstrip('x')}))) AS margin FROM {src})")
    c1 = (f"{prefix}1 AS (SELECT {k}CASE WHEN margin > 0 THEN array_to_string(list_transform(bl, lambda x:"
          f" CASE WHEN x = '' THEN x WHEN length(x) <= margin THEN ' ' ELSE substring(x, margin + 1) END), chr(10))"
          f" ELSE body END AS ded FROM {prefix}0)")
    return ",\n".join([c0, c1]), f"{prefix}1"
