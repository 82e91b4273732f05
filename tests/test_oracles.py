"""Every registered query against its oracle, and the driver's three functions."""

import pytest
from comparing import assert_same

import __spark_entry__
from symtab.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name])


def test_each_operator_of_the_survey_has_a_query():
    numbers = {int(name[3:5]) for name in registry.QUERIES}
    assert numbers == set(range(1, 66))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "sid", "name", "tier"]
    assert df.count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
