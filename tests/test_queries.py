"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from gleanings.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def cell(x):
        return "~" if x is None else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = plain(tuple(r[c] for c in names) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    theirs = plain(rel.select(", ".join(f'"{c}"' for c in names)).fetchall())
    assert sorted(rel.columns) == names
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1
