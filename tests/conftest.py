import datetime as dt
import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cashweave.session import local_session, shared_dir  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "cashweave-tests")
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def day(text):
    return dt.date.fromisoformat(text) if text else None


def dec(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
