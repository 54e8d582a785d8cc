import os
import shutil
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from arcspark.session import build  # noqa: E402

DATA = os.environ.get("ARCSPARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="arcspark-tests-")
    own = build(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.driver.memory": "3g"},
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
