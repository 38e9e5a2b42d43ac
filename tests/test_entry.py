"""Every registered query with SQL gives what DuckDB gives, at the smallest scale."""

import duckdb
import pytest

from vecspark.plans import queries as core

#: These build nine collections or several graphs; the comparison at sf0.01 covers them.
SLOW = {"index_parity"}


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [q for q in core.QUERIES if q not in SLOW])
def test_query(spark, db, sf_dir, name):
    rows = core.QUERIES[name](spark, sf_dir)
    names = sorted(rows.columns)
    got = sorted(rows.select(*names).collect(), key=repr)
    if name not in core.ORACLES:
        assert got
        return
    want = db.execute(f"SELECT {', '.join(names)} FROM ({core.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
