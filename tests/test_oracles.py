"""Every urban query against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from urbanloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = plain(df.select(*columns).collect())
    if name not in registry.ORACLES:
        assert found
        return
    cur = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})")
    want = plain(cur.fetchall())
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(not isinstance(v, str) for v in b) else all(x == y or (isinstance(x, (int, float)) and x == pytest.approx(y, abs=2e-6)) for x, y in zip(a, b, strict=True))
