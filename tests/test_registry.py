"""Every registered query against its SQL counterpart on the smallest supplied tables."""

import re

import pytest

import __spark_entry__ as entry_points
from microfolio.catalog import ORACLE, QUERIES
from tests.harness import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem, _, _ = compare(spark, con, SF, name)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry_points(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_no_query_name_is_numbered_only():
    assert not [n for n in QUERIES if re.fullmatch(r"op\d+.*", n)]
