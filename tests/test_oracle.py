import pytest

from tributary.queries import collect

QUERIES, ORACLE = collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(compare, name):
    compare(QUERIES[name], ORACLE[name])


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
