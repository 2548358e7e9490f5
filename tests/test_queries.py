"""Registered queries against their SQL, each in a scope that leaves nothing behind."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect
from plan_checks import plan_problems

import __spark_entry__ as entry
from orderflow.plans import catalog
from orderflow.session import child_names, shared_dir, staging_scope

SF = os.environ.get("ORDERFLOW_SF", "/root/testdata/sf0.001")
# Those of the training-data operators have tests of their own.
NAMES = [n for n in entry.queries() if n in catalog.QUERIES]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    before = child_names(spark, f"{shared_dir(spark)}/orderflow")
    with staging_scope(spark):
        df = entry.queries()[name](spark, SF)
        assert plan_problems(df) == []
        sql = entry.oracle_sql().get(name)
        if sql is None:
            assert df.count() > 0
        else:
            assert compare(name, df, duck, sql) == []
    assert set(child_names(spark, f"{shared_dir(spark)}/orderflow")) == set(before)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
