import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), os.environ.get("PYTHONPATH", "")) if p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lorekeep.engine.session import get_session

    return get_session("tests", cores=4, shuffle_partitions=4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
