import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfrank.session import local_session  # noqa: E402

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return str(DATA)


@pytest.fixture(scope="session")
def tables(spark, folder):
    from shelfrank.sources.bindings import Tables

    return Tables(spark, folder)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}
