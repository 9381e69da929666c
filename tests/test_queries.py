"""Every core query beside its SQL, on the smallest tables."""

import oracle
import pytest

from parcelspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, small, name):
    assert oracle.compare(spark, con, registry.QUERIES[name], registry.SQL[name], small) == ""


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
