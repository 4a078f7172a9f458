import pytest

from loomgraph.plans import oracles, queries, roundtrips

ORACLE_SQL = oracles.ORACLE_SQL | roundtrips.ORACLE_SQL
QUERIES = queries.QUERIES | roundtrips.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_sample_is_exact_and_repeatable(spark):
    one, two = (sorted(map(tuple, QUERIES["sample_exact_n"](spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert one == two and len(set(one)) == 50
