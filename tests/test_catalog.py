"""Every registered query runs on the smallest scale; selected ones match
their DuckDB oracle."""

import duckdb
import pytest

import __spark_entry__ as E
from gavel.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "final_decision" in df.columns


def test_oracles_registered_for_queries():
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 80


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    res = duck.execute(catalog.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    df = catalog.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(ocols)
    assert srows
    assert _canon(srows, df.columns) == _canon(orows, ocols)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables, the streamed ones as folders of part files in no order."""
    import shutil

    from pyspark.sql import functions as F
    sf = tmp_path_factory.mktemp("folders")
    for t in TABLES:
        if t in ("events", "documents", "lineitem"):
            spark.read.parquet(f"{SF}/{t}.parquet").repartition(3, F.rand(5)).write.parquet(f"{sf}/{t}.parquet")
        else:
            shutil.copy(f"{SF}/{t}.parquet", sf / f"{t}.parquet")
    return str(sf)


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if n.startswith("str0")))
def test_streams_over_part_files_match_oracle(spark, duck, folders, monkeypatch, name):
    from gavel.streaming import jobs
    monkeypatch.setattr(jobs, "FILES_A_TRIGGER", 1, raising=False)
    res = duck.execute(catalog.oracle_sql()[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    df = catalog.queries()[name](spark, folders)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(orows, ocols)
