"""Every registered query with an oracle, at the smallest scale; results must be equal value by value."""

import pytest

from slatework.catalog import ORACLES, QUERIES
from slatework.verify import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = oracle_connection(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, oracle, name):
    assert compare(QUERIES[name](spark, FOLDER), oracle, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["e2_resolution_fuzzy", "j18_fuzzy_join", "m18_slate_scoring", "m22_drivers", "m26_stratified_split", "b14_pick_features"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "entry_form_signal" in entry.queries()
