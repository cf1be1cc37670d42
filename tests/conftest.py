import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from quillspan.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return session("local[4]", "tests", partitions=4, memory="3g", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
