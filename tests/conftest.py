import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from demandlens.session import build_session

    session = build_session("tests", cpus=8, partitions=8, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
