"""Every registered query against its SQL counterpart on the smallest test data."""

import pytest
from compare import connect, differences, type_differences

import __spark_entry__ as entry
from haulcast import catalog
from oracle import statements

SOURCE = "/root/testdata/sf0.001"
STATEMENTS = statements()


@pytest.fixture(scope="module")
def con():
    return connect(SOURCE)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, con, name):
    frame = entry.queries()[name](spark, SOURCE)
    assert differences(frame, con, STATEMENTS[name]) == []
    assert type_differences(frame, con, STATEMENTS[name]) == []


@pytest.mark.parametrize("name", sorted(catalog.runs().keys() - STATEMENTS.keys()))
def test_model_fed_queries_have_rows(spark, name):
    frame = entry.queries()[name](spark, SOURCE)
    assert len(set(frame.columns)) == len(frame.columns)
    assert frame.count() > 0


def test_every_statement_has_a_query():
    assert STATEMENTS.keys() <= catalog.runs().keys()
    assert STATEMENTS.items() <= entry.oracle_sql().items()
    assert catalog.runs().keys() <= entry.queries().keys()


def test_only_results_of_the_logistic_model_lack_sql():
    lacking = catalog.runs().keys() - STATEMENTS.keys()
    assert lacking == {*catalog.RISK_FED, "order_late_risk_scored", "order_late_risk_scored_ml", "late_risk_metrics"}


def test_entry_is_lazy_and_stable(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0
