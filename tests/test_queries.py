"""Every registered query against its SQL twin on the same tables."""

import os
import re

import pytest
from compare import connect, difference

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    # The twin has to work as a view, too.
    duck.execute(f"CREATE OR REPLACE VIEW twin AS {ORACLES[name]}")
    assert difference(QUERIES[name](spark, SF_DIR), duck, "SELECT * FROM twin") is None


def test_only_the_forests_have_no_twin():
    text = re.compile(r"op\d+_|pipeline$")
    assert {n for n in set(QUERIES) - set(ORACLES) if not text.match(n)} == {"forest_impute", "impute_error", "oob_error", "state_limits"}


def test_entry_has_rows(spark):
    assert contract.entry(spark).columns == ["id", "visdate", "measure"]
    assert contract.entry(spark).count() > 0
