"""Every registered query beside its SQL in another engine, or else its rows."""

from __future__ import annotations

import pytest

import __spark_entry__
from engramlake.plans.registry import QUERIES, SQL
from tests.conftest import SF, assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
