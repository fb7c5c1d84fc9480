import pytest

from tests.oracle import SF, oracle, rows_of
from tidelog import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    want = oracle(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows_of(got) == rows_of(want)
