import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from regimecast.session import build_session  # noqa: E402
from regimecast.sources.views import Views  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("regimecast-tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def views(spark):
    return Views(spark, SMALL)


@pytest.fixture
def tiny_groups(spark):
    """Make every group above 40 rows count as oversized."""
    spark.conf.set("spark.regimecast.maxGroupRows", "40")
    yield
    spark.conf.unset("spark.regimecast.maxGroupRows")


def rows(df, digits=9):
    """Rows as sorted tuples, doubles rounded."""

    def cell(v):
        return round(v, digits) + 0.0 if isinstance(v, float) else v

    names = sorted(df.columns)
    return sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=repr)
