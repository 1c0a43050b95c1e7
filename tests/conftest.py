import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tomewise.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="6g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows(df):
    """All rows as sorted tuples."""
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is not None, v) for v in r))
