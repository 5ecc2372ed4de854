"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from seguekit import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = plans.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    """Exact values as they are; numbers as doubles, to be compared within the error of sums in another order."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def coarse(v):
    """For the order of rows only."""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(tuple(map(coarse, v))) if isinstance(v, tuple) else str(v)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, isinstance(x, float), coarse(x)) for x in r))


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)
    return a == b


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(REGISTRY.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b)][:3] == []


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert REGISTRY.QUERIES[name](spark, SF).count() > 0
