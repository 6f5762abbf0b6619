import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(_HERE))
#: Workers import the package and functions of the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(_HERE), _HERE, os.path.join(_HERE, "llm"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_session

    session = get_session("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
