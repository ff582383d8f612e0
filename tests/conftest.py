import pytest

from handful.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", partitions=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of a frame."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
