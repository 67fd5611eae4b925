import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Collect a DataFrame as a set of tuples of the named columns."""

    def collect(df, *columns):
        return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}

    return collect
