"""Every training-data query that has SQL, against DuckDB on the smallest tables; the others have brute-force tests."""

import duckdb
import pytest

from shredline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "labels", "conversations")


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(map(value, r)) for r in cur.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if any(isinstance(v, float) for v in a) else a == b


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
