"""Every core query over tables without rows, with nulls in every column, and with extra columns of clashing names."""

import pytest

from ledgerloom.plans import registry

QUERIES = registry.queries()
#: Aggregates over the whole table have one row, or one a column or metric, even without rows.
SOME = {"plan_equivalence": 1, "group_sizes": 1, "group_sizes_low": 1, "profile_integrity": 1, "profile_distinct": 3, "profile_blanks": 24}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_without_rows(spark, variants, name):
    assert QUERIES[name](spark, f"{variants}/empty").count() == SOME.get(name, 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_everywhere(spark, variants, name):
    QUERIES[name](spark, f"{variants}/nulls").write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q[0] == "p" and q[1].isdigit()))
def test_extra_columns_change_nothing(spark, data, variants, name):
    a, b = (sorted(map(repr, QUERIES[name](spark, d).collect())) for d in (data, f"{variants}/extra"))
    assert a == b
