"""Every registered query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from docloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def agrees(duck, spark, name, sql, tmp_path):
    driver.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    duck.sql(f"create or replace table want as {sql}")
    duck.sql(f"create or replace table got as select * from '{tmp_path}/out/*.parquet'")
    kinds = lambda t: {r[0]: r[1] for r in duck.sql(f"describe {t}").fetchall()}
    assert kinds("got") == kinds("want")
    columns = ", ".join(f'"{c}"' for c in kinds("want"))
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.sql(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(duck, spark, name, tmp_path):
    agrees(duck, spark, name, catalog.ORACLE_SQL[name], tmp_path)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert driver.queries()[name](spark, SF).collect() is not None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
