"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import pytest
from conftest import SF, plain

from quern.plans import registry

QUERIES, ORACLES = registry.collect()


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = rows(names, df.collect())
    assert got
    if name in ORACLES:
        c = duck.execute(ORACLES[name])
        columns = [d[0] for d in c.description]
        assert sorted(columns) == names
        assert got == rows(names, [dict(zip(columns, r, strict=True)) for r in c.fetchall()])


def test_oracles_belong_to_queries():
    assert ORACLES.keys() <= QUERIES.keys()
