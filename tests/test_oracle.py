"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from verification.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


OWN = set(entry.verified_here())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, SF, name)
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_only_named_queries_lack_sql():
    assert OWN - set(entry.oracle_sql()) == {"chunk_text"}  # tested by brute force in test_folds
