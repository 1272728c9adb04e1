"""The iteration traces that Spark builds by the run's number (``iteration_rows``)
against the shared SQL text, and the plans of the queries over them."""

import re

import pytest

from gavel.operators import ordered as O
from gavel.plans import catalog as E
from gavel.sources.bridges import bridge, iteration_rows

SCHEMA = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
          "l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string")
ROWS = [
    (1, 9, 1, 2, 5.0, 10.0, 0.03, "R", "O"), (1, 8, 1, 1, 4.0, 11.0, 0.02, "R", "F"),
    (10, 3, 2, 1, 1.0, 12.0, 0.07, "R", "O"), (10, 3, 1, 1, 2.0, 13.0, 0.01, "A", "F"),
    (100, 1, 1, None, 3.0, 14.0, None, None, "O"), (100, 1, 1, 1, None, None, 0.05, "R", None),
    (None, 1, 1, 1, 5.0, 2.0, 0.0, "R", "O"), (None, 2, 1, 1, 4.0, 1.0, 0.0, "N", "O"),
    (-7, 5, 5, 3, 6.0, 3.0, 0.04, "N", "F"), (-7, 5, 5, 3, 6.0, 3.0, 0.04, "N", "F"),
    *[(2, k, 1, k, float(k), 10.0 * k, 0.01 * k, "R" if k == 4 else "N", "O") for k in range(1, 7)]]


@pytest.fixture()
def sf(spark, tmpdir_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmpdir_path}/lineitem.parquet")
    return tmpdir_path


def _same(a, b):
    assert a.dtypes == b.dtypes
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_iteration_rows_are_the_rows_of_the_shared_text(spark, sf):
    _same(iteration_rows(spark, sf).drop("run_key"), bridge(spark, sf, "b_iter"))


def test_operators_by_number_return_what_they_return_by_name(spark, sf):
    by_number, by_name = iteration_rows(spark, sf), bridge(spark, sf, "b_iter")
    _same(O.baseline_summary(by_number, by="run_key"), O.baseline_summary(by_name))
    _same(O.iteration_fold(by_number, by="run_key"), O.iteration_fold(by_name))
    first = {r.run: r for r in O.baseline_summary(by_number, by="run_key").collect()}
    assert set(first) == {"run__1", "run__10", "run__100", "run__-7", "run__2", None}
    assert (first["run__10"].total_tests, first["run__10"].tests_failed) == (2, 1)  # the tie goes to the smaller supplier


@pytest.mark.parametrize("name", ["met14_baseline_summary", "met01_step_metrics", "win02_iteration_fold", "win06_cri_series"])
def test_runs_are_dealt_and_sorted_by_number_once(spark, sf, name):
    """Names of runs begin alike: sorting by them compares whole rows, and they are
    carried by the exchange."""
    plan = E.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["run_key"]
    assert not re.search(r"Sort \[run#", plan)
