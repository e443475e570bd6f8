"""The corpus queries that SQL can express give the rows that DuckDB gives."""

import pytest
from conftest import SF, plain

from quern.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    c = duck.execute(ORACLES[name])
    names = [d[0] for d in c.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple(map(str, r)))
    got = rows(tuple(r[n] for n in names) for r in df.collect())
    assert got and got == rows(c.fetchall())
