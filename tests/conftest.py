import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a DataFrame as sorted tuples of the named columns."""
    def collect(df, *names):
        found = [tuple(r) for r in df.select(*(names or df.columns)).collect()]
        return sorted(found, key=lambda r: [(v is not None, str(type(v)), v) for v in r])

    return collect
