"""One small local session for all tests."""

import pytest

from storelake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(8, **{
        "spark.checkpoint.dir": str(folder),
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
    })
    session.sparkContext.setCheckpointDir(str(folder))
    yield session
    session.stop()
