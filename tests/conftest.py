import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from loomstone.session import ensure_checkpoint_dir, session

    s = session("local[4]", 4, spark__ui__showConsoleProgress="false")
    ensure_checkpoint_dir(s)
    return s
