"""Every registered query of the core against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from belated.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(values):
    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(plain(v) for v in r) for r in values), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    want = rows(duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall())
    assert got == want
