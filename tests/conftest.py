import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from check_queries import session
    s = session("4", 4)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlens-test-"))
    yield s


@pytest.fixture
def split_everything(spark):
    """Treat every group as hot."""
    spark.conf.set("spark.fleetlens.hotRows", "0")
    yield
    spark.conf.unset("spark.fleetlens.hotRows")
