import os

import duckdb
import pytest

from factloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_every_query_has_its_twin():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(map(repr, (tuple(r) for r in found.select(columns).collect())))
    twin = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(map(repr, twin))


def test_long_conversations(spark, tmp_path):
    """Turns with gaps, ties, nulls and far numbers, against brute force."""
    turns = {1: list(range(13)), 2: [0, 1, 9, 11, 30], 3: [0, 1, 1, 2], 4: [3, 20], 5: [0]}
    rows = [(c, t, f"r{t % 2}", "x") for c, own in turns.items() for t in own] + [(1, None, "r0", "x"), (None, 3, "r0", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    after, odd, reached, ring, real = set(), set(), set(), set(), {(c, t) for c, own in turns.items() for t in own}
    for c, own in turns.items():
        own = sorted(set(own))
        ring |= {(f"T{c}.{s}", f"T{c}.{t}") for s in own for t in own}
        chain = own
        after |= {(f"T{c}.{s}", f"T{c}.{t}") for s in chain for t in chain if s < t}
        if own[0] == 0:
            reached |= {(c, t) for t in chain}
            odd |= {(f"T{c}.{t}",) for t in chain[1::2]}
    want = {
        "tc_conv": after,
        "nonlinear": after,
        "mutual_rec": odd,
        "base_and_derived": {(f"T{c}.{t}",) for c, t in reached},
        "strata3": {(f"T{c}.{t}", f"r{t % 2}") for c, t in reached & real if t},
        "tc_cycle": ring,
    }
    for name, rows in want.items():
        found = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(found) == len(set(found)) and set(found) == rows, name
