"""Every registered query against its SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import norm, table

SF = os.environ.get("CAIRN_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries(), oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def places(v):
    """Decimal places that a number is written with."""
    return max(0, -decimal.Decimal(repr(float(v))).as_tuple().exponent) if isinstance(v, (int, float)) else 0


def units(rows):
    """For each column, one unit of its last rounded place, or null where it is not rounded."""
    deep = [max((places(v) for v in column), default=0) for column in zip(*rows)]
    return [10.0 ** -d if d <= 10 else 0.0 for d in deep]


def coarse(row):
    return repr(tuple(f"{v:.4g}" if isinstance(v, float) else v for v in row))


def close(a, b, unit=0.0):
    """Equal, or off by one unit of the last rounded place (a sum in another order may round the other way)."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y, unit) for x, y in zip(a, b))
    number = (int, float)
    return a == b or isinstance(a, number) and isinstance(b, number) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01 * unit if isinstance(a, float) or isinstance(b, float) else 0.0)


def differences(got, want, cols):
    """The cells that differ, rows matched in coarse order."""
    unit = units([*got, *want])
    return [(c, x, y) for a, b in zip(sorted(got, key=coarse), sorted(want, key=coarse)) for c, x, y, u in zip(cols, a, b, unit) if not close(x, y, u)]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    cols, got = table(QUERIES[key](spark, SF))
    if key not in SQL:
        assert got
        return
    cur = con.execute(SQL[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if got != want:
        assert len(got) == len(want)
        assert not differences(got, want, cols)[:20]
