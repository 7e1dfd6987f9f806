import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.driver.memory": "8g",
            # Fixtures are tiny: compiling generated code would take most of the time.
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
