import os

import duckdb
import pytest

from factloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    found = QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    rows = sorted(map(repr, map(tuple, found.collect())))
    assert rows == sorted(map(repr, con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()))
