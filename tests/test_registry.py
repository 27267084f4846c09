"""Queries against their SQL on the smallest tables, where those are there."""

import os

import pytest

from lakeshelf.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    want = sql.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), columns)


def test_sizes_beyond_a_gigabyte_are_as_in_the_sql(spark, sql, tmp_path):
    keys = "SELECT unnest([1, 4, 4095, 4096, 4194303, 4194304, 5000001, 36000000, 60000000, 4194304000, 42949672960, 60000000000]) AS o_orderkey"
    sql.execute(f"COPY ({keys}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    want = sql.execute(registry.oracle_sql()["format_bytes"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet'")).fetchall()
    got = registry.queries()["format_bytes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_filters_reach_the_scan(spark, tmp_path):
    from lakeshelf.operators.where import compile_where
    from lakeshelf.sources.tables import documents_as_files

    path = str(tmp_path / "files")
    documents_as_files(spark, SF).write.parquet(path)
    plan = spark.read.parquet(path).where(compile_where({"kind": "text", "size": {"gt": 5}, "mime": "TEXT/plain", "folder": {"startsWith": "/docs"}})).select("id")._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(deleted_at,0)", "EqualTo(kind,text)", "GreaterThan(size,5)", "EqualTo(mime,text/plain)", "StringStartsWith(folder,/docs/)"):
        assert part in plan
    schema = plan.split("ReadSchema:")[1].split(">")[0]
    assert "text_lower" not in schema and "notes" not in schema


def test_entry_point_stands_alone(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(registry.queries()) <= set(entry.queries())
