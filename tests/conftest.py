import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from formlake.operators.skew import SPLIT_ROWS_CONF  # noqa: E402
from formlake.session import spark_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = spark_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_rows(spark):
    """Sets the size above which a key is split, for one test."""

    def set_rows(n):
        spark.conf.set(SPLIT_ROWS_CONF, str(n))

    yield set_rows
    spark.conf.unset(SPLIT_ROWS_CONF)
