import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from patternloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # The tables are tiny: compiling code and many partitions cost more than they save.
    small = {"spark__sql__shuffle__partitions": "2", "spark__sql__codegen__wholeStage": "false"}
    session = local_session(8, "patternloom-tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), **small)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
