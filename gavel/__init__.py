"""gavel: a Spark-native engine for governing automated code-repair results.

Predictions, statuses, evaluator outcomes and security reports are tables;
every per-record rule is a Column expression and every job a DataFrame plan.

Layout
------
functions/  Column -> Column expressions (text, diff, security, metrics, crypto)
operators/  DataFrame -> DataFrame operators (governance, aggregates, ordered
            folds, joins, task-suite jobs, cards, Python parse check)
sources/    file readers (predictions, statuses, reports, logs ...) and the
            bridges that derive those tables from the shared parquet data
sinks/      writers (JSONL, CSV, status-table edits)
plans/      the named query catalogue and its DuckDB oracle SQL
streaming/  Structured Streaming forms of the batch jobs
"""

import sys as _sys

__all__ = ["session"]

# Ship the package's Python functions (Arrow UDF bodies and their helpers) by
# value with each task, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
    pass
