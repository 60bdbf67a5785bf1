import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import local_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": f"{shared}/warehouse"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
