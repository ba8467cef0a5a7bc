"""Every registered query of the copy-number operators against its SQL, at the smallest scale."""

import pytest

from karyon.plans import registry

from .compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


def test_every_query_runs(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, SF).count() > 0, name
