"""The registered queries that SQL can express, against it; all of them run on the smallest tables."""

import pytest

from hirelake.llm import queries

from ..oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    compare(spark, connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
