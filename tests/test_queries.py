"""Every query with SQL gives the same rows as that SQL; the others run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__  # noqa: E402
from lexlake.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        missing, extra, _ = oracle.differences(df, con, registry.ORACLES[name])
        assert not missing and not extra, (missing, extra)
    else:
        assert df.count() > 0


def test_entry_module(spark):
    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 0
