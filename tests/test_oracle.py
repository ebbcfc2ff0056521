"""Every registered query against its SQL."""

import pytest

import oracle_check
from pairforge.queries.catalog import QUERIES
from pairforge.queries.oracle import ORACLE


@pytest.fixture(scope="module")
def duck(sf):
    return oracle_check.connect(sf)


def test_sql_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, physical, name):
    df = QUERIES[name](spark, sf)
    assert "NestedLoop" not in physical(df) and "Cartesian" not in physical(df)
    assert oracle_check.differences(df, duck, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_counts_every_status(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r["status"] for r in rows} <= {"error", "empty", "identical", "small_diff", "length_ratio", "kept"}
    assert sum(r["n"] for r in rows) > 0
