import pytest
from compare import duck_rows, spark_rows

from asofkit import catalogue, catalogue_facts, catalogue_pit, catalogue_stored  # noqa: F401

SQL, QUERIES = catalogue.oracle_sql(), catalogue.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(sf, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["pit_as_of"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
