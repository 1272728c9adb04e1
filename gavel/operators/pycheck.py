"""Python parse check for added code (SEC-13), the only per-row Python step.

Spark has no Python parser, so this runs as an Arrow-batched pandas UDF.
Callers pass null for every row whose outcome does not depend on the parse
(see ``functions.security.diff_scan_columns``), so at scale the UDF sees only
the small subset of rows without regex findings that look like Python.
"""

from __future__ import annotations

import ast
import textwrap

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: assignment targets the structural scan treats as sensitive
SENSITIVE_NAMES = ("password", "secret", "api_key", "token", "auth_token")


def scan_completes(snippet: str) -> bool:
    """True when the dedented snippet parses and the structural scan can run
    over it: a truthy non-text constant assigned to a sensitive name makes
    that scan fail (it measures the literal's length)."""
    try:
        tree = ast.parse(textwrap.dedent(snippet))
    except Exception:  # SyntaxError, ValueError, RecursionError, MemoryError
        return False
    for node in ast.walk(tree):
        if not (isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant)):
            continue
        value = node.value.value
        if not value or isinstance(value, (str, bytes)):
            continue
        for target in node.targets:
            if isinstance(target, ast.Name) and any(s in target.id.lower() for s in SENSITIVE_NAMES):
                return False
    return True


@F.pandas_udf(T.BooleanType())
def _python_scan_ok(snippets: pd.Series) -> pd.Series:
    return snippets.map(lambda s: None if s is None else scan_completes(s)).astype("boolean")


# Marked non-deterministic so the optimizer never moves or copies the call
# (e.g. into a pushed-down filter on the decision columns): it is computed
# exactly once per row, in its own Arrow stage.
python_scan_ok = _python_scan_ok.asNondeterministic()
