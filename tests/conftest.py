import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.plans.session import get_spark

    s = get_spark(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="sparkloom-tests-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="sparkloom-wh-")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
