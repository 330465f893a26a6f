"""Every registered query against DuckDB, where it has SQL, on the small tables."""

from __future__ import annotations

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from larkspur.plans import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = db.execute(registry.oracle_sql()[name])
    named = [x[0] for x in found.description]
    assert sorted(named) == columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    registry.queries()[name](spark, sf_dir).collect()
