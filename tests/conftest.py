import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "threadlake-tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "4"})
