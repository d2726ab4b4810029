"""Every query of the engine's own operators against its DuckDB SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from lexloom import registry

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"repetition_detect"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("module", registry.MODULES)
def test_module(spark, con, module):
    from importlib import import_module

    plans = import_module(f"lexloom.plans.{module}")
    wrong = {}
    for name, query in plans.QUERIES.items():
        sql = plans.ORACLES.get(name)
        if sql is None:
            query(spark, SF).count()
        elif (found := compare(spark, con, name, query, sql, SF)) not in (None, "empty" if name in MAY_BE_EMPTY else None):
            wrong[name] = found
    assert not wrong


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
