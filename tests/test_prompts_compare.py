"""Prompt assembly (TXT-25), table comparison (SET-5), added lines of many files (TXT-9)."""

import time
from collections import Counter

from pyspark.sql import functions as F

from gavel.functions import text as X
from gavel.operators.ordered import row_differences, rows_equal
from gavel.operators.prompts import patch_prompts, task_prompts

ATTEMPTS = "task string, step long, code string, output string, lint array<string>, viol array<string>"


def test_prompts_join_the_last_attempt(spark):
    specs = spark.createDataFrame([("a", "A", "python", "do"), ("b", "B", "python", "it"), ("c", "C", "go", None)],
                                  "task string, name string, language string, spec string")
    attempts = spark.createDataFrame([("a", 1, "old", "1 failed", ["x"], None), ("a", 2, "new", None, None, ["v", "w"]),
                                      ("c", 1, None, "out", ["E1", "E2"], []), (None, 9, "z", "z", [], [])], ATTEMPTS)
    got = {r.task: r.prompt for r in task_prompts(specs, spark.createDataFrame([("b", "start")], "task string, starter string"), attempts).collect()}
    assert got["a"] == ("Task: A\nLanguage: python\n\nSpecification:\ndo\n\nYou wrote the following code which FAILED tests or checks:\n"
                        "```python\nnew\n```\n\nTest / linter / security output:\n\nLinter errors: []\nSecurity violations: ['v', 'w']\n\n"
                        "Repair the code. Focus on fixing failing tests and security issues. Return ONLY the corrected code.")
    assert got["b"].endswith("```python\nstart\n```\n\nWrite a complete, working solution in one file. Return ONLY the final code.")
    assert "Specification:\n\n\nYou wrote" in got["c"] and "```go\n\n```" in got["c"] and "Linter errors: ['E1', 'E2']" in got["c"]
    patches = {r.task: r.prompt for r in patch_prompts(
        specs, spark.createDataFrame([("a", "SNAP")], "task string, snapshot string"), attempts).collect()}
    assert patches["a"].startswith("Task: A\n\ndo\n\nYour previous patch failed to apply or did not solve the problem.\n")
    assert "\n\nLinter errors:\n\n\nSecurity violations:\nv\nw\n\nRelevant code snapshot:\n```python\nSNAP\n```\n\n" in patches["a"]
    assert "Relevant code:\n```python\n\n```\n\nCRITICAL" in patches["b"] and "+new line\n context line\n\nRules:\n1." in patches["b"]


def test_row_differences_equal_a_count(spark):
    schema = "k long, v string, a array<string>, t timestamp, d double"
    rows = [(k % 40, None if k % 7 == 0 else f"v{k % 3}", [None, "x"] if k % 5 else ["x", None], None, float(k % 2)) for k in range(300)]
    other = rows[5:] + rows[:2] + [(1, None, None, None, None)]
    a, b = spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(other[::-1], schema).repartition(3)
    key = lambda r: (r[0], r[1], None if r[2] is None else tuple(r[2]), r[3], r[4])
    left, right = Counter(map(key, rows)), Counter(map(key, other))
    for buckets in (1, 7, 4096):
        got = {key((r.k, r.v, r.a, r.t, r.d)): (r.only_left, r.only_right) for r in row_differences(a, b, buckets).collect()}
        assert got == {r: (max(left[r] - right[r], 0), max(right[r] - left[r], 0)) for r in left | right if left[r] != right[r]}
    same = rows_equal(a, a.select("d", "t", "a", "v", "k").repartition(2)).first()
    assert tuple(same) == (0, 0, 300, 300)
    none = rows_equal(a.limit(0), b.limit(0)).first()
    assert tuple(none) == (0, 0, 0, 0)
    # nulls in other places, and values that differ below a millisecond, are differences
    x = spark.sql("SELECT CAST(NULL AS INT) AS p, 1 AS q, TIMESTAMP '2020-01-01 00:00:00.000001' AS t")
    y = spark.sql("SELECT 1 AS p, CAST(NULL AS INT) AS q, TIMESTAMP '2020-01-01 00:00:00.000001' AS t")
    z = spark.sql("SELECT CAST(NULL AS INT) AS p, 1 AS q, TIMESTAMP '2020-01-01 00:00:00.000002' AS t")
    assert rows_equal(x, y).first().only_left == 1 and rows_equal(x, z).first().only_right == 1


def _added(text):
    out, path, hunk = [], None, False
    for i, x in enumerate(text.split("\n")):
        if x.startswith("diff --git "):
            path, hunk = None, False
        elif x.startswith("@@ "):
            hunk = True
        elif x.startswith("+++ "):
            path = x.split()[1].removeprefix("b/")
        elif x.startswith("+") and hunk:
            out.append((i, path, x[1:]))
    return out


def test_added_lines_of_many_files(spark):
    def patch(files, lines):
        return "\n".join(f"diff --git a/f{k} b/f{k}\n--- a/f{k}\n+++ b/f{k}\n@@ -1 +1 @@\n" + "\n".join(
            f"{'+' if j % 2 else ' '}l{k}-{j}" for j in range(lines)) for k in range(files))

    odd = ["", "+x", "@@ -1 @@\n+before any file\n+++ b/late\n+y\ndiff --git a/a b/a\n+no hunk\n@@ -1 @@\n+no path\n+++ b/p\n+z\n@@ -2 @@\n+w",
           "diff --git a/a b/a\ndiff --git a/b b/b\n+++ b/b\n@@ -1 @@\n+q"]
    texts = odd + [patch(30, 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, t string")
    got = {r.seq: [tuple(x) for x in r.a] for r in df.select("seq", X.added_lines("t").alias("a")).collect()}
    assert got == {k: _added(t) for k, t in enumerate(texts)}

    def seconds(files):
        one = spark.createDataFrame([(patch(files, 50),)], "t string")
        started = time.time()
        n = one.select(F.size(X.added_lines("t")).alias("n")).first().n
        assert n == files * 25
        return time.time() - started
    seconds(10)
    small, large = seconds(250), seconds(2000)
    assert large < 24 * max(small, 0.2)  # eight times the lines; all pairs of lines and files would be 64
