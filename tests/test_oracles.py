import pytest

from gatewell.plans import registry
from tests.oracle import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, name):
    found = rows_of(QUERIES[name](spark, SF))
    if name not in SQL:
        assert found[1]
        return
    assert found == rows_of_sql(SQL[name], SF)


def test_names_are_one_to_one():
    assert set(SQL) <= set(QUERIES)
