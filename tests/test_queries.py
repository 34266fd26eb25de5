"""Every query with SQL against DuckDB, on the smallest tables."""

import random

import duckdb
import pytest

from compare import TABLES, rows
from corvid.plans.catalog import ORACLE_SQL, QUERIES
from corvid.plans.lookup_queries import misspelling

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r.asDict(recursive=True).values()) for r in df.collect()])
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_misspellings_of_short_names(spark, tmp_path):
    random.seed(14)
    names = {"", "a", "b", "ab", "cd", "abcd", "xbxd"} | {"".join(random.choices("abcd", k=random.randint(1, 9))) for _ in range(400)}
    spark.createDataFrame([(n,) for n in sorted(names)], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = misspelling(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(db.execute(ORACLE_SQL["misspelling"]).fetchall())
