import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from capstrata.session import local_session
    return local_session("tests", cpus=4, partitions=4)


@pytest.fixture
def sliced(spark):
    """Force the path for hot keys by allowing only a few rows per task."""
    from capstrata.session import SLICES_KEY
    spark.conf.set(SLICES_KEY, "7")
    yield spark
    spark.conf.unset(SLICES_KEY)
