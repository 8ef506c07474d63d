"""Every registered query against its DuckDB oracle on the smallest driver tables.

The same comparison the driver runs at sf0.01: column names, row count and
the order-insensitive multiset of values (floats rounded). Every query of the
library has an oracle; those of optional subpackages are compared by their own tests.
"""

import math

import duckdb
import pytest

import __spark_entry__ as E
from shredline.plans.catalog import load_all
from shredline.sources.tables import DRIVER_TABLES, table_path

from conftest import SF_SMALL


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


OWN = load_all()
NAMES = sorted(OWN)

SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "binary": "BLOB"}


def test_every_query_has_an_oracle():
    assert [name for name, (_fn, sql) in OWN.items() if not sql] == []
    assert set(OWN) <= set(E.queries()) and set(OWN) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    stypes = dict(df.dtypes)
    assert {d[0]: str(d[1]) for d in cur.description} == {c: SPARK_TO_DUCK.get(t, t) for c, t in stypes.items()}
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["tenant_id", "user_id", "email", "phone"]
    assert any(r.email is None for r in rows) and any(r.email is not None for r in rows)
