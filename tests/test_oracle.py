"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference

from netlens.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf), duck, SQL[name]) is None


def test_every_query_without_sql_is_known():
    # these have tests of their own
    assert set(QUERIES) - set(SQL) == {
        "linked_campaigns", "incident_report", "evaluation_report", "isolation_forest",
        "train_predict", "multiclass_boosted", "combined_classifier", "train_report", "cross_dataset", "retrain_gate", "contributions"}


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
