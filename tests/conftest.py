import os
import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rowtide.session import local_session

    # one machine: a temporary folder is as shared as any
    os.environ.setdefault("SPARK_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="rowtide-tests-"))
    session = local_session(8)
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()
