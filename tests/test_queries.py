"""Every registered query against its SQL, or at least run to its end."""

from __future__ import annotations

import pytest

from ledgerline.plans.registry import ORACLES, QUERIES
from tests.compare import SF, expected, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert rows_of(df.columns, df.collect()) == expected(ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
