import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    import oracle_check

    from roadlens.plans.city import release
    s = oracle_check.session()
    yield s
    release(s)
    s.stop()
