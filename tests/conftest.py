import pytest

from tests.compare import spark_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = spark_session()
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()
