import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
NOW = "2024-01-31 00:00:00"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="ledgerline-tests", shuffle_partitions=8)
    yield s
    s.stop()
