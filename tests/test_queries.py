"""Registered queries beside their SQL twins on the smallest driver tables."""

import os

import pytest

import casebook
from casebook.compare import compare, duck

SF = "/root/testdata/sf0.001"
casebook.load_all()
# modules whose queries run in well under a second each; the rest is compared by casebook.compare
QUICK = [n for n, f in casebook.QUERIES.items() if f.__module__.split(".")[-1] in ("projections", "contracts") and n in casebook.SQL]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    message, _, _ = compare(spark, con, SF, name)
    assert message.startswith("ok"), message


def test_every_sql_has_a_query():
    assert set(casebook.SQL) <= set(casebook.QUERIES)
