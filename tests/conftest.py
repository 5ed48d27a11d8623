import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from vigilframe import session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    built = session.build_session(
        "vigilframe-tests", "local[8]",
        **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
            "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
        },
    )
    yield built
    built.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
