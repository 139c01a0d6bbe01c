import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from loanlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "loanlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def app(spark, sf_dir):
    """The applicant table with derived columns, written once for all tests."""
    from loanlens.plans.queries import featured
    from loanlens.session import settle

    return settle(featured(spark, sf_dir))
