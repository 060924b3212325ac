import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMOKE = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from railyard.session import build_session

    s = build_session("local[4]", app_name="railyard-tests", shuffle_partitions=8)
    # tests only: a scratch checkpoint folder when the session names none
    from railyard.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="railyard-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="railyard-test-")
