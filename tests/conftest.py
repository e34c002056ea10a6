import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_session, shared_checkpoint_dir

    session = get_session("cohortlens-tests", master="local[*]", shuffle_partitions=8)
    shared_checkpoint_dir(session)  # unset in tests: pick a scratch folder
    yield session
    session.stop()
