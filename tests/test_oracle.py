"""Every registered query against its SQL in DuckDB."""

import __spark_entry__ as entry
import pytest
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 8 and "mean" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF).count() > 0
        return
    result = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert result.startswith("ok"), result
