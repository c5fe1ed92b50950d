import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from searchloom.session import get_session

    s = get_session("tests", master="local[4]", shuffle_partitions=4, extra={"spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
