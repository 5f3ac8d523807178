"""Every query outside the training-data subpackage against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from quillmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.oracle_sql():
        found = duck.sql(catalog.oracle_sql()[name])
        assert sorted(found.columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(found.fetchall(), found.columns)
