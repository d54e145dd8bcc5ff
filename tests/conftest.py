import pytest

from resiq.session import local_session, ship_by_value


@pytest.fixture(scope="session")
def spark():
    ship_by_value()
    s = local_session(4, shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"
