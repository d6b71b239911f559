"""Every query against independent SQL in DuckDB, over whole tables."""

import compare
import pytest

import __spark_entry__ as entry
import oracles
from clickloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES
ORACLES = oracles.ORACLES
# At sf0.001 one feature separates the classes, so the fit has no optimum: its weights are compared on a larger table.
MODEL_QUERIES = {
    "propensity_model_evaluation", "propensity_model_scores", "propensity_model_coefficients", "propensity_model_residuals",
}
MODEL_FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - MODEL_QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(MODEL_QUERIES))
def test_model_query_equals_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, MODEL_FOLDER), compare.connect(MODEL_FOLDER), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(MODEL_QUERIES))
def test_model_query_has_rows_without_an_optimum(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
