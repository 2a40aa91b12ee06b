import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from wayfare.plans.session import local_session

    session = local_session("4", 4, **{"spark_ui_showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session
