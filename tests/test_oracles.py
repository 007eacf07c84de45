"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from carelake.plans import catalog

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if hasattr(x, "isoformat"):
            return str(x.tz_localize(None) if getattr(x, "tzinfo", None) else x)[:26]
        if isinstance(x, float):
            return round(x, 9)
        return x.item() if hasattr(x, "item") else x

    names = sorted(frame.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in frame[names].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, db):
    got = rows(catalog.QUERIES[name](spark, DATA).toPandas())
    if name in catalog.ORACLES:
        want = rows(db.sql(catalog.ORACLES[name]).df())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert [repr(x) for x in got[1]] == [repr(x) for x in want[1]] or got[1] == want[1]
