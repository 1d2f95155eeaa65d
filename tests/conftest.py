import pytest

from arcwise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "arcwise-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
