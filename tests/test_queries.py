"""Every registered query of the library against its SQL, on the small tables."""

import math
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

from weftlens.queries import ORACLE_SQL, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    out = QUERIES[name](spark, FOLDER)
    columns = sorted(out.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in out.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want
