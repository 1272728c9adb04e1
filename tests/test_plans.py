"""Plan-level guards for scale: no product joins anywhere, projections and
filters reach the parquet scans, the sweep scans its input once."""

import pytest

from gavel.plans import catalog as E

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in E.queries() if not n.startswith("str"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_product_joins(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned(spark):
    plan = _plan(E.queries()["met15_governed_eval"](spark, SF))
    # only the columns the bridges use are read from documents/events/labels
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
    assert "n_chars" not in plan
    sweep = _plan(E.queries()["agg04_risk_coverage"](spark, SF))
    assert sweep.count("FileScan parquet") == 1


def test_patch_text_stays_out_of_the_exchanges(spark):
    """Also without broadcasts only narrow columns move in the flagship query."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.queries()["met15_governed_eval"](spark, SF)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    inputs = [block.split("\nInput", 1)[1].split("\n", 1)[0] for block in plan.split("\n\n")
              if ") Exchange" in block.split("\n", 1)[0] and "\nInput" in block]
    assert inputs
    assert not any(" patch#" in i or " text#" in i or "model_patch#" in i or "[patch#" in i for i in inputs), inputs
