"""Every query of the core against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    with duckdb.connect() as c:
        for t in TABLES:
            if Path(f"{sf}/{t}.parquet").exists():
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        yield c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([str([plain(r[k]) for k in order]) for r in found])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = df.collect()
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    a, b = rows(df.columns, [tuple(r) for r in found]), rows(names, want)
    if a != b:
        extra, lacking = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        raise AssertionError(f"{len(a)} rows, {len(b)} wanted\nnot wanted: {extra}\nnot found: {lacking}")
