"""Patch normalisation, diff predicates and added-line extraction."""

from pyspark.sql import functions as F

from gavel.functions import security as S
from gavel.functions import text as X
from gavel.functions import textops as TX


def _norm(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    staged = X.with_normalized_patch(df, "p", "out").orderBy("i").select("out").collect()
    single = df.select("i", X.normalize_patch(F.col("p")).alias("out")).orderBy("i").select("out").collect()
    assert [r.out for r in staged] == [r.out for r in single]
    return [r.out for r in staged]


def test_normalize_cases(spark):
    indented = ("    diff --git a/x.py b/x.py\n    --- a/x.py\n    +++ b/x.py\n    @@ -1,2 +1,2 @@\n"
                "     keep\n    \n    -old\n    +new\n")
    fenced = "Sure!\n```diff\ndiff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n-x\n+y\n```\nThanks"
    prose = "I changed it.\n\ndiff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n-x\n+y\n"
    no_plus = "Notes\n--- section\nmore text"
    crlf = "﻿diff --git a/a b/a\r\n--- a/a\r\n+++ b/a\r\n"
    py_fence = "```python\nprint(1)\n```"
    out = _norm(spark, [indented, fenced, prose, no_plus, "", None, crlf, py_fence])
    assert out[0] == "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n keep\n \n-old\n+new\n"
    assert out[1] == "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n-x\n+y\n"
    assert out[2] == "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n-x\n+y\n"
    assert out[3] == "Notes\n--- section\nmore text\n"
    assert out[4] == "\n" and out[5] == "\n"
    assert out[6] == "diff --git a/a b/a\n--- a/a\n+++ b/a\n"
    assert out[7] == "python\nprint(1)\n"


def test_added_lines_and_hunks(spark):
    no_space = "diff --git a/x b/x\n--- a/x\n+++ b/src/a.py\n@@\n+token = 'abcdef'\n"
    short_hunk = "+++ b/src/a.py\n@@ -1 +1 @@\n+x = 1\n"
    two_files = ("diff --git a/a b/a\n+++ b/a.py\n@@ -1,1 +1,1 @@\n+one\ndiff --git a/b b/b\n+++ b/b.py\n+two\n"
                 "@@ -1,1 +1,1 @@\n+three\n")
    df = spark.createDataFrame([(0, no_space), (1, short_hunk), (2, two_files)], "seq int, p string")
    arr = {r.seq: [(a.path, a.line) for a in r.a] for r in df.select("seq", X.added_lines(F.col("p")).alias("a")).collect()}
    assert arr[0] == []
    assert arr[1] == [("src/a.py", "x = 1")]
    assert arr[2] == [("a.py", "one"), ("b.py", "three")]
    rows = X.explode_added_lines(df, "p").orderBy("seq", "pos").collect()
    assert [(r.seq, r.path, r.line) for r in rows] == [(1, "src/a.py", "x = 1"), (2, "a.py", "one"), (2, "b.py", "three")]
    v = df.select("seq", X.validate_unified_diff(F.col("p")).alias("ok")).orderBy("seq").collect()
    assert [r.ok for r in v] == [False, False, True]


def test_secret_findings(spark):
    def diff(path, line):
        return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -0,0 +1,1 @@\n+{line}\n"
    long_value = "x" * 200
    cases = [diff("src/a.py", 'api_key = "abcdef"'), diff("tests/test_a.py", 'api_key = "abcdef"'),
             diff("src/a.py", 'token = "my_example_key"'), diff("src/a.py", '# token = "abcdef"'),
             diff("src/a.py", f'password = "{long_value}"')]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "seq int, p string")
    out = {r.seq: r.f for r in df.select("seq", S.secret_findings(X.added_lines(F.col("p"))).alias("f")).collect()}
    assert out[0] == ['[high] SECRETS_POSSIBLE_HARDCODED@src/a.py: api_key = "abcdef"']
    assert out[1] == ['[info] SECRETS_POSSIBLE_HARDCODED@tests/test_a.py: api_key = "abcdef"']
    assert out[2][0].startswith("[info] ")
    assert out[3] == []
    snippet = out[4][0].split(": ", 1)[1]
    assert len(snippet) == 160 and snippet.endswith("...")


def test_small_predicates(spark):
    df = spark.createDataFrame([("Windows\\Tests\\x.py",), ("src/x_test.py",), ("src/x.py",), (None,)], "p string")
    got = [r.t for r in df.select(X.is_test_path("p").alias("t")).collect()]
    assert got == [True, True, False, False]
    t = spark.createDataFrame([("[info] a",), ("  [high] b",), ("c",)], "v string")
    tags = t.select(X.tag_violation("v").alias("t"), X.violation_severity("v").alias("s")).collect()
    assert [(r.t, r.s) for r in tags] == [("[info] a", "info"), ("  [high] b", "high"), ("[high] c", "high")]
    logs = spark.createDataFrame([("5 passed",), ("5 passed, 2 failed",), ("2 failed, 5 passed",),
                                  ("FAILED (failures=2)",), ("passed",), ("",)], "o string")
    parsed = [tuple(r.r) for r in logs.select(TX.parse_test_output("o").alias("r")).collect()]
    assert parsed == [(5, 0), (7, 2), (5, 0), (2, 2), (1, 0), (1, 1)]


def test_infra_predicates(spark):
    df = spark.createDataFrame([("Error: docker container start timed out after 120 seconds",),
                                ("Command timed out after 300 seconds",), ("all good",)], "p string")
    r = df.select(X.infra_timeout_docker("p").alias("a"), X.infra_timeout_phrase("p").alias("b")).collect()
    assert [(x.a, x.b) for x in r] == [(True, True), (False, True), (False, False)]
