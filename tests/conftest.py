import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from sourcemart.session import build_session
    session = build_session(cores=4, shuffle_partitions=2)
    session.sparkContext.setLogLevel("OFF")
    # Fixtures have a few rows: compiling a stage costs far more than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""
    def collect(frame, *columns):
        found = [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]
        return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
    return collect
