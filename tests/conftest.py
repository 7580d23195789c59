import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lessonlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def rows(spark):
    """Build a small table from tuples and a DDL schema."""
    return lambda data, ddl: spark.createDataFrame(data, ddl)
