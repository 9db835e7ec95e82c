"""Every query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from veilframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(name, spark, duck):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(row[names.index(c)]) for c in columns) for row in rel.fetchall())
    assert got == want
