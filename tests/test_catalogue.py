import pytest

from tests.oracle import DATA, compare
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_oracle(spark, name):
    n = compare(catalogue.QUERIES[name](spark, f"{DATA}/sf0.01"), catalogue.SQL[name], f"{DATA}/sf0.01")
    assert n > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
