import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Spark's Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session

    # Tests run on one machine with no cluster checkpoint folder configured,
    # so a scratch folder stands in for it.
    s = build_session("local[*]", app="tessera-tests", shuffle_partitions=8,
                      fallback_checkpoint_dir=tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp"))
    yield s
    s.stop()
