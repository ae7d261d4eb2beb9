import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from courtside.session import build_session
    ckpt = tempfile.mkdtemp(prefix="courtside-test-ckpt-")
    s = build_session("local[4]", 4, app="courtside-tests",
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from courtside.sources.fixtures import Fixture
    return Fixture(spark, SF_SMALL)


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all when none given)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
