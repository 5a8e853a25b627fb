import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    spark = session()
    yield spark
    spark.stop()


def values(df, *columns):
    """All rows as tuples, ordered as they come."""
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
