import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from knotwork.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4)
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """A DataFrame's rows as a sorted list of tuples, nulls last."""

    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))

    return get
