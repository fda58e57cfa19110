"""Rows that a query needn't search for."""

import sys

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, share", [("o54_o56_exemplars", 0.2), ("o75_patch_floor", 0.6)])
def test_only_rows_that_are_asked_for_are_searched(spark, monkeypatch, name, share):
    import __spark_entry__

    evaluation, queries = sys.modules["patchlake.plans.evaluation"], __spark_entry__.queries()
    seen, search = [], evaluation.nearest_mean
    monkeypatch.setattr(evaluation, "nearest_mean", lambda queries, bank, *a, **b: seen.append(queries.count()) or search(queries, bank, *a, **b))
    queries[name](spark, SF).count()
    assert seen == [share * evaluation.bank_rows(spark, SF).count()]
