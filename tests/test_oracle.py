"""Every query with an SQL twin gives the same rows; the others give some rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare, duck

SQL = entry.oracle_sql()
# Trained models and grids without a twin that run in a few seconds; tests/test_models.py covers the rest.
ROWS_ONLY = [
    "clu7_random_memberships", "clv7_better_clustering", "clv_all_indices", "ens4_stacking", "int5_bootstrap",
    "mdl7_vanilla_forest", "mdl8_boosted_trees", "mdl9_linear_lags_full", 
    "tst6_against_reference_holm",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", [*SQL, *ROWS_ONLY])
def test_query(spark, con, name):
    assert compare(spark, con, name, SMALL) is None


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
