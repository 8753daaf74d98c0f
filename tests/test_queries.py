"""Every registered query of the engine runs; those with SQL equal DuckDB."""

import math

import duckdb
import pytest

from meshlag.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
# the whole resampling and surrogate runs are tested with fewer iterations in test_operators.py
SLOW = {"null_summary", "on_off_days"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: str(v)[:10] if hasattr(v, "isoformat") else None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        result = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        want = _rows(names, result.fetchall())
        assert sorted(names) == sorted(df.columns)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(y))), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
