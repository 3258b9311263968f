"""Every query against its DuckDB statement, over whole tables of the smallest scale."""

import pytest

from checks.compare import compare, duck
from checks.oracle import all_sql
from checks.queries import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_statement():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    problems, _, _, _ = compare(spark, con, name, all_queries()[name], all_sql()[name], SF)
    assert problems == []
