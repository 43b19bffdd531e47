import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pricelake.session import local_session, ship

    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame has the rows of a SQL text, in any order."""

    def check(df, sql):
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        cols = sorted(df.columns)
        assert cols == sorted(names)
        want = sorted((repr(tuple(_value(r[names.index(c)]) for c in cols)) for r in got.fetchall()))
        have = sorted(repr(tuple(_value(r[c]) for c in cols)) for r in df.collect())
        assert have == want

    return check
