import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vitalis.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", cpus=4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
