"""Every operator's query against its SQL on the smallest tables, and which of them SQL cannot express."""

from __future__ import annotations

import pytest
from compare import connect, differences, type_differences

import __spark_entry__ as entry
from haulcast.llm import queries

SOURCE = "/root/testdata/sf0.001"
STATEMENTS = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SOURCE)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, con, name):
    frame = queries.queries()[name](spark, SOURCE)
    assert differences(frame, con, STATEMENTS[name]) == []
    assert type_differences(frame, con, STATEMENTS[name]) == []


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - STATEMENTS.keys()))
def test_other_queries_have_rows(spark, name):
    frame = queries.queries()[name](spark, SOURCE)
    assert len(set(frame.columns)) == len(frame.columns)
    assert frame.count() > 0


def test_every_operator_is_registered():
    assert queries.queries().items() <= entry.queries().items()
    assert STATEMENTS.items() <= entry.oracle_sql().items()
    assert STATEMENTS.keys() <= queries.queries().keys()
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries() if name != "pipeline") == list(range(1, 14))
    assert queries.queries().keys() - STATEMENTS.keys() == {
        "pipeline", "op1_sequence_files", "op3_log_bilinear", "op4_robust_outliers", "op5_dom_marginals",
        "op6_positive_unlabelled", "op9_licence_scan", "op10_best_fit_packing",
        "op13_tokenizer_alignment",
    }
