import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reviewflow.session import build_session

    os.environ["REVIEWFLOW_LOCAL_WORK"] = str(tmp_path_factory.mktemp("work"))
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_mid():
    return "/root/testdata/sf0.01"
