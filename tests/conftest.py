import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    d = tmp_path_factory.mktemp("shared")
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                spark__checkpoint__dir=str(d))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
