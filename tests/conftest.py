import logging

import pytest

from tests.session import make_session

logging.disable(logging.CRITICAL)


@pytest.fixture(scope="session")
def spark():
    s = make_session()
    yield s
    s.stop()


@pytest.fixture
def small_tasks(spark):
    """A row bound so low that every key is cut into slices and blocks."""
    spark.conf.set("spark.cairn.taskRows", "40")
    yield
    spark.conf.unset("spark.cairn.taskRows")
