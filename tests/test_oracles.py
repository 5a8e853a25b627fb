"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import DATA, compare, connect

import __spark_entry__ as contract
from uptake.workloads import load_all

QUERIES, ORACLES = load_all()
DIRECTORY = os.environ.get("ORACLE_SF_DIR", f"{DATA}/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES) <= set(contract.queries())


# Physical operators that would leave the JVM or pair every row with every other.
BANNED = (
    "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, DIRECTORY)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in BANNED if operator in plan]
    _, message = compare(frame, con, ORACLES[name])
    assert not message, message


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == [
        "Category", "Year", "Total_Registrations", "EV_Registrations", "EV_Penetration_Percent"]
    assert frame.count() > 0
