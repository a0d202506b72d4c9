"""Every query of the subpackage over tables without rows, with nulls in every column, and with extra columns of clashing names."""

import pytest

from ledgerloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_without_rows(spark, variants, name):
    assert QUERIES[name](spark, f"{variants}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_everywhere(spark, variants, name):
    QUERIES[name](spark, f"{variants}/nulls").write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_change_nothing(spark, data, variants, name):
    a, b = (sorted(map(repr, QUERIES[name](spark, d).collect())) for d in (data, f"{variants}/extra"))
    assert a == b
