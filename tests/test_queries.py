"""Every registered query with SQL agrees with the other engine; the hard ones also on the large-input paths."""

import pytest
from compare import difference
from testdata import DATA

from tidemark.plans.bindings import Bindings
from tidemark.plans.catalogue import REGISTRY

CHECKED = sorted(n for n, q in REGISTRY.items() if q.oracle)
LARGE = [
    "cohort_index_stays", "incident_labels", "window_labels_narrow", "lab_statistics", "dictionary_lookup",
    "medication_features", "compact_feature_matrix", "winsorised_means", "temporal_cutpoints", "split_stratified",
    "cohort_profile", "equal_frequency_bins", "score_metrics", "select_thresholds", "group_metrics", "risk_deciles",
    "scale_robust", "permutation_importance",
]


def check(spark, oracle, name):
    q = REGISTRY[name]
    got = q.run(Bindings(spark, DATA)).toPandas()
    assert difference(got, oracle.execute(q.oracle).df()) is None


@pytest.mark.parametrize("name", CHECKED)
def test_agrees(spark, oracle, name):
    check(spark, oracle, name)


@pytest.mark.parametrize("name", LARGE)
def test_agrees_on_large_input_paths(spark, oracle, large_paths, name):
    check(spark, oracle, name)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = {r["condition"]: r for r in entry.entry(spark).collect()}
    assert rows["diab"]["subjects"] == 137 and rows["diab"]["prevalent"] == 42
